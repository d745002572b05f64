"""Search over captioned windows: cosine top-k, lexical rerank, recency blend; and browsing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.functions.text import split_caption, tokenize
from frameloom.functions.timefmt import iso
from frameloom.functions.vector import cosine, hash_features
from frameloom.session import cut


@dataclass(frozen=True)
class SearchOptions:
    """k of the vector stage, n of the result, and the blend with recency."""

    ann_k: int = 60
    top_n: int = 5
    recency_weight: float = 0.6
    half_life_s: float = 300.0
    digits: int = 9


def overlaps(t_from=None, t_to=None, start: str = "t_start", end: str = "t_end") -> Column:
    """Closed overlap with optional bounds: touching counts (F1)."""
    out = F.lit(True)
    if t_from is not None:
        out = out & (F.col(end) >= F.lit(t_from))
    if t_to is not None:
        out = out & (F.col(start) <= F.lit(t_to))
    return out


def cosine_topk(vectors: DataFrame, query: list[float], *, id_col: str, vec_col: str, k: int, digits: int = 9, repeats: bool = False) -> DataFrame:
    """The k rows most similar to a query vector, ties by id (O1). One pass with a bounded heap per task.

    Scores are rounded before ordering, so that the order doesn't hang on the
    order of summation. Rows with a null or empty vector take no part.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = vectors.filter(F.size(vec_col) > 0).withColumn("ann_score", F.round(cosine(vec_col, q), digits))
    rows = rows.drop(vec_col)
    if repeats:
        rows = rows.dropDuplicates([id_col])
    return rows.orderBy(F.desc("ann_score"), F.col(id_col)).limit(k)


def lexical_rerank(candidates: DataFrame, query_terms: list[str], *, text_col: str, digits: int = 9) -> DataFrame:
    """Adds ``rerank_score``: the share of the query's IDF mass that a candidate covers (AG15, Q3).

    IDF is over the candidates; a term that none has stays in the denominator.
    Query terms number a few, so they are counted as conditional sums in one
    aggregate, without exploding the texts.
    """
    terms = sorted(set(query_terms))
    if not terms:
        return candidates.withColumn("rerank_score", F.lit(0.0))
    words = tokenize(text_col)
    marked = candidates.withColumn("_has", F.array(*[F.array_contains(words, t) for t in terms]))
    stats = marked.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("_has")[i]).alias(f"d{i}") for i in range(len(terms))])
    weights = [F.log(1 + F.col("n") / (1 + F.col(f"d{i}"))) for i in range(len(terms))]
    stats = stats.select(F.array(*weights).alias("_w"))
    total = F.aggregate("_w", F.lit(0.0), lambda s, x: s + x)
    got = F.aggregate(F.zip_with("_w", "_has", lambda w, h: F.when(h, w).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    return marked.crossJoin(F.broadcast(stats)).withColumn("rerank_score", F.round(F.coalesce(got / total, F.lit(0.0)), digits)).drop("_w", "_has")  # stats: one row


def take_ranked(candidates: DataFrame, ranking: DataFrame, *, position: str = "position") -> DataFrame:
    """Candidates in the order a model returned, with a 0-based ``rank`` (Q2).

    ``candidates`` have their 0-based ``position``; ``ranking`` (index, score)
    names positions, best score first, equal scores by position. An index that
    no candidate has raises.
    """
    rows = ranking.join(candidates, F.col("index") == F.col(position), "left")
    known = F.when(F.col(position).isNull(), F.raise_error(F.format_string("the ranking names candidate %d, which there is not", F.col("index"))).cast("int")).otherwise(F.row_number().over(Window.orderBy(F.desc("score"), "index")) - 1)
    return rows.withColumn("rank", known).drop("index")


def context_line(key: str = "chunk_id", start: str = "t_start", end: str = "t_end", text: str = "caption") -> Column:
    """``[id] start .. end: caption``."""
    return F.concat(F.lit("["), F.col(key), F.lit("] "), iso(start), F.lit(" .. "), iso(end), F.lit(": "), F.coalesce(F.col(text), F.lit("")))


def recency_blend(ranked: DataFrame, *, order: list[Column], options: SearchOptions, end: str = "t_end") -> DataFrame:
    """Adds ``rank`` (0-based): relevance and recency, both over the candidates, blended.

    A weight or half-life of 0 or fewer than two rows leave the order.
    """
    everything = Window.partitionBy()
    before = ranked.withColumn("_order", F.row_number().over(Window.orderBy(*order)))
    if options.recency_weight <= 0 or options.half_life_s <= 0:
        return before.withColumn("combined", F.col("rerank_score")).withColumn("rank", F.col("_order") - 1).drop("_order")
    low, high, last = F.min("rerank_score").over(everything), F.max("rerank_score").over(everything), F.max(end).over(everything)
    relevance = F.when(high > low, (F.col("rerank_score") - low) / (high - low)).otherwise(0.5)
    age = (F.unix_micros(last.cast("timestamp")) - F.unix_micros(F.col(end).cast("timestamp"))) / 1e6
    combined = F.round((1 - options.recency_weight) * relevance + options.recency_weight * F.pow(F.lit(0.5), F.greatest(F.lit(0.0), age) / options.half_life_s), options.digits)
    return before.withColumn("combined", combined).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("combined"), "_order")) - 1).drop("_order")


def search(
    chunks: DataFrame, query: str, vector: list[float] | None = None, *, t_from=None, t_to=None, tier: str | None = "live", options: SearchOptions | None = None, dims: int = 64, repeats: bool = False
) -> DataFrame:
    """Embed, filter, cosine top-k, rerank, blend, top-n (Q1).

    ``vector`` replaces the feature-hash embedding of the query. Only captioned
    rows with a vector take part; with ``repeats`` a chunk_id may come again and
    counts once. After the top-k everything works on at most
    ``ann_k`` rows, so the unpartitioned windows of the later stages are small.
    """
    o = options or SearchOptions()
    words = _words(query)
    v = vector if vector is not None else hash_features(words, dims)
    rows = chunks.filter(overlaps(t_from, t_to)).filter((~F.col("gated")) & (F.size("embedding") > 0))
    if tier is not None:
        rows = rows.filter(F.col("tier") == tier)
    top = cosine_topk(rows, v, id_col="chunk_id", vec_col="embedding", k=o.ann_k, digits=o.digits, repeats=repeats)
    ranked = lexical_rerank(top, words, text_col="caption", digits=o.digits)
    order = [F.desc("rerank_score"), F.desc("ann_score"), F.col("chunk_id")]
    return recency_blend(ranked, order=order, options=o).filter(F.col("rank") < o.top_n)


def _words(text: str) -> list[str]:
    import re

    return re.findall(r"[a-z0-9]+", text.lower())


def browse(chunks: DataFrame, *, gated: bool | None = None, contains: str = "", tier: str | None = None, t_from=None, t_to=None, newest_first: bool = True, offset: int = 0, limit: int = 25, repeats: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(page, total)``: a page of rows in order of (t_start, chunk_id), and the count without paging.

    ``contains`` is a plain, case-insensitive part of the caption; blank means
    no filter. Negative offsets and limits count as 0. With ``repeats`` a
    chunk_id may come again and counts once, after the filters.
    """
    rows = chunks.filter(overlaps(t_from, t_to))
    if gated is not None:
        rows = rows.filter(F.col("gated") == gated)
    if tier is not None:
        rows = rows.filter(F.col("tier") == tier)
    needle = contains.strip().lower()
    if needle:
        rows = rows.filter(F.lower("caption").contains(needle))
    if repeats:
        rows = rows.dropDuplicates(["chunk_id"])
    way = F.desc if newest_first else F.asc
    page = rows.orderBy(way("t_start"), way("chunk_id")).offset(max(0, offset)).limit(max(0, limit))
    return page, rows.agg(F.count(F.lit(1)).alias("total"))


def page_numbers(total: DataFrame, page: int, size: int) -> DataFrame:
    """Page size clamped to 1..200, number of pages, and the page, 0 if it is empty."""
    size = max(1, min(200, size))
    pages = F.ceil(F.col("total") / size).cast("long")
    return total.select("total", F.lit(size).alias("page_size"), pages.alias("pages"), F.when((F.lit(page) >= 1) & (F.lit(page) <= pages), F.lit(page)).otherwise(0).alias("page"))


def fetch(chunks: DataFrame, ids: list[str]) -> DataFrame:
    """Rows by id in the order of the ids, with ``pos``; unknown ids are skipped, repeated ids give repeated rows."""
    wanted = chunks.sparkSession.createDataFrame([(i, x) for i, x in enumerate(ids)], "pos int, chunk_id string")
    return chunks.join(F.broadcast(wanted), "chunk_id").orderBy("pos")  # the caller's list


def upsert(current: DataFrame, batches: list[DataFrame], key: str = "chunk_id") -> DataFrame:
    """Keyed union in which the row of the latest batch wins (SK1, SO2)."""
    cols = current.columns
    rows = current.select(*cols, F.lit(0).alias("_v"))
    for i, b in enumerate(batches, 1):
        rows = rows.unionByName(b.select(*cols, F.lit(i).alias("_v")))
    best = rows.groupBy(key).agg(F.max_by(F.struct(*cols), "_v").alias("_r"))
    return best.select("_r.*")


def with_embeddings(chunks: DataFrame, embed) -> DataFrame:
    """Fill missing vectors of captioned rows from the caption's description (SK3); gated rows stay without (SK4).

    ``embed`` makes a vector column of a text column; it runs only on rows that
    need it.
    """
    missing = ~F.coalesce("gated", F.lit(True)) & (F.coalesce(F.size("embedding"), F.lit(0)) <= 0)
    text = F.when(missing, split_caption("caption")["description"])
    made = chunks.withColumn("_text", text)
    # Apart, so that rows with a vector don't pass through the model; written first, as a Python model can't take the parser's lambdas in.
    asked = cut(made.filter(F.col("_text").isNotNull()))
    return made.filter(F.col("_text").isNull()).drop("_text").unionByName(asked.withColumn("embedding", embed(F.col("_text"))).drop("_text"))


def insert(current: DataFrame, chunks: DataFrame, embed, dims: int = 64) -> tuple[DataFrame, DataFrame]:
    """``(table, refused)``: the table with the valid rows in it, and the others with the rule they break (SK2).

    Valid rows get their missing vectors and replace rows of the same id; of a
    batch's rows with one id the one with the greatest t_start counts.
    """
    problems = violations(chunks, dims)
    refused = problems.dropDuplicates(["chunk_id"])
    good = chunks.join(refused.filter("chunk_id is not null").select("chunk_id"), "chunk_id", "left_anti").filter("coalesce(chunk_id, '') <> ''")
    cols = current.columns
    one = good.groupBy("chunk_id").agg(F.max_by(F.struct(*[c for c in cols]), F.coalesce(F.unix_micros(F.col("t_start").cast("timestamp")), F.lit(-(2**62)))).alias("_r")).select("_r.*")
    return upsert(current, [cut(with_embeddings(cut(one), embed))]), refused


def delete(current: DataFrame, ids: DataFrame, key: str = "chunk_id") -> tuple[DataFrame, DataFrame]:
    """``(left, deleted)``: the rows without the ids, and how many ids were there (SK5, J11)."""
    ids = ids.select(key).distinct()
    gone = current.join(ids, key, "left_semi").select(key).distinct().agg(F.count(F.lit(1)).alias("deleted"))
    return current.join(ids, key, "left_anti"), gone


def violations(chunks: DataFrame, dims: int = 64) -> DataFrame:
    """``(chunk_id, problem)``: the first broken rule of the chunk contract per row (F-V1)."""
    text, n = F.coalesce("caption", F.lit("")), F.coalesce(F.size("embedding"), F.lit(0))
    n = F.greatest(n, F.lit(0))
    problem = (
        F.when(F.coalesce("chunk_id", F.lit("")) == "", "no id")
        .when(F.col("t_end") < F.col("t_start"), "ends before it starts")
        .when(F.coalesce("segment", F.lit("")) == "", "no segment")
        .when(F.col("gated") & ((text != "") | (n > 0)), "gated with caption or vector")
        .when(~F.col("gated") & (text == ""), "no caption")
        .when(~F.col("gated") & (n > 0) & (n != dims), "vector of another length")
    )
    return chunks.select("chunk_id", problem.alias("problem")).filter("problem is not null")
