"""Queries of the chunk index, retrieval, time algebra and text functions, with the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.functions import text as tx
from frameloom.functions import timefmt as tf
from frameloom.functions.keys import canon_file, canon_id, micros
from frameloom.functions.vector import hash_embed, norm
from frameloom.operators import gate, health, retrieval, timeline
from frameloom.plans.tables import table

# Fixed parameters of the queries; every query runs over its whole tables.
QUESTION = "a rigger kneels by the crane track with a maroon tripod"
SEED_VECTOR_ID = 7
ZONE = "America/Los_Angeles"
T_FROM, T_TO = "2026-01-05 02:00:00", "2026-01-05 06:00:00"
CUTOFF = "2026-01-05 04:00:00"


def chunks(spark: SparkSession, sf_dir: str, *, vectors: bool = False, repeats: bool = False, where: str | None = None, t_from: str | None = None, t_to: str | None = None) -> DataFrame:
    """Chunks once each, with canonical camera and segment, and times also in microseconds.

    Rows of one chunk_id are equal, so filters may go before they are made
    distinct: ``where`` is a condition on the columns as stored, ``t_from`` and
    ``t_to`` bound the overlap in time; both reach the scan. With ``repeats``
    the rows are left as they come.
    """
    c = table(spark, sf_dir, "chunks")
    at = lambda name, text: F.lit(text).cast(c.schema[name].dataType)
    if t_from is not None:
        c = c.filter(F.col("t_end") >= at("t_end", t_from))
    if t_to is not None:
        c = c.filter(F.col("t_start") <= at("t_start", t_to))
    if where is not None:
        c = c.filter(where)
    cols = ["chunk_id", canon_id("camera_id").alias("camera_id"), F.col("t_start").cast("timestamp").alias("t_start"), F.col("t_end").cast("timestamp").alias("t_end"), micros("t_start").alias("start_us"), micros("t_end").alias("end_us"), canon_file("segment").alias("segment"), "pts_offset", "tier", "gated", "caption"]
    c = c.select(*cols, *(["embedding"] if vectors else []))
    return c if repeats else c.dropDuplicates(["chunk_id"])


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment files once each per camera and start, with effective ends."""
    s = table(spark, sf_dir, "segments").select(canon_id("camera_id").alias("camera_id"), canon_file("path").alias("path"), micros("seg_start").alias("start_us"), micros("mtime").alias("mtime_us"), "size_bytes").filter("camera_id is not null and start_us is not null and path <> ''")
    one = s.groupBy("camera_id", "start_us").agg(F.min("path").alias("path"), F.max("mtime_us").alias("mtime_us"), F.max("size_bytes").alias("size_bytes"))
    return timeline.effective_ends(one)


_CH = """ch as (select * from (select chunk_id, lower(trim(camera_id)) as camera_id, t_start, t_end, epoch_us(t_start) as start_us, epoch_us(t_end) as end_us,
  lower(trim(regexp_extract(segment, '[^/]*$'))) as segment, pts_offset, tier, gated, caption, embedding from chunks)
  qualify row_number() over (partition by chunk_id) = 1)"""
_SEG = """sg as (select camera_id, start_us, min(path) as path, max(mtime_us) as mtime_us, max(size_bytes) as size_bytes from (
  select lower(trim(camera_id)) as camera_id, lower(trim(regexp_extract(path, '[^/]*$'))) as path, epoch_us(seg_start) as start_us, epoch_us(mtime) as mtime_us, size_bytes
  from segments) where camera_id is not null and start_us is not null and path <> '' group by 1, 2),
se as (select *, case when coalesce(nx <= start_us + 62000000, false) then nx else start_us + 60000000 end as eff_end, not coalesce(nx <= start_us + 62000000, false) as nominal
  from (select *, lead(start_us) over (partition by camera_id order by start_us) as nx from sg))"""
_TOK = "regexp_extract_all(lower({}), '[a-z0-9]+')"

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL if it has one."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return keep


# --- The index: counts, browsing, filters, merges ------------------------------------------------


@query(f"with {_CH} select count(*) as total, count(*) filter (not gated) as captioned, count(*) filter (gated) as gated, round(count(*) filter (gated) / count(gated), 6) as skip_rate from ch")
def index_counts(spark, sf_dir):
    return health.index_counts(chunks(spark, sf_dir))


@query(f"with {_CH} select camera_id, count(*) as total, count(*) filter (not gated) as captioned, count(*) filter (gated) as gated, round(case when count(gated) = 0 then 0 else count(*) filter (gated) / count(gated) end, 6) as skip_rate from ch group by camera_id")
def skip_rate_by_camera(spark, sf_dir):
    return health.index_counts(chunks(spark, sf_dir), ["camera_id"])


@query(f"with {_CH}, c as (select camera_id, count(*) as total, round(case when count(gated) = 0 then 0 else count(*) filter (gated) / count(gated) end, 6) as skip_rate from ch group by 1) select camera_id, total, case when total = 0 then 'empty' when skip_rate >= 0.6 then 'ok' else 'low' end as health from c")
def gate_health(spark, sf_dir):
    return health.gate_health(health.index_counts(chunks(spark, sf_dir), ["camera_id"])).select("camera_id", "total", "health")


@query(f"with {_CH}, c as (select count(*) filter (not gated and coalesce(caption, '') <> '') as captioned, count(*) filter (gated) as skipped, count(*) as n from ch) select captioned, skipped, n - captioned - skipped as undecided, round(skipped / (captioned + skipped), 6) as skip_rate from c")
def ingest_run_stats(spark, sf_dir):
    return health.run_stats(chunks(spark, sf_dir))


_PAGE = ["chunk_id", "camera_id", "start_us", "gated", "caption"]


@query(f"with {_CH} select chunk_id, camera_id, start_us, gated, caption from ch order by t_start desc nulls last, chunk_id desc limit 25 offset 50")
def browse_page(spark, sf_dir):
    return retrieval.browse(chunks(spark, sf_dir, repeats=True), offset=50, limit=25, repeats=True)[0].select(*_PAGE)


@query(f"with {_CH} select chunk_id, camera_id, start_us, gated, caption from ch where contains(lower(caption), 'crane track') order by t_start desc, chunk_id desc limit 200")
def browse_contains(spark, sf_dir):
    return retrieval.browse(chunks(spark, sf_dir, repeats=True), contains="  Crane Track ", limit=200, repeats=True)[0].select(*_PAGE)


@query(f"with {_CH} select chunk_id, camera_id, start_us, gated, caption from ch where gated order by t_start desc, chunk_id desc limit 25")
def browse_gated_only(spark, sf_dir):
    return retrieval.browse(chunks(spark, sf_dir, repeats=True), gated=True, repeats=True)[0].select(*_PAGE)


@query(f"with {_CH} select chunk_id, camera_id, start_us, gated, caption from ch where tier = 'live' and t_start is not null order by t_start, chunk_id limit 25")
def browse_oldest_first(spark, sf_dir):
    return retrieval.browse(chunks(spark, sf_dir, repeats=True, where="t_start is not null"), tier="live", newest_first=False, repeats=True)[0].select(*_PAGE)


@query(f"with {_CH}, t as (select count(*) as total from ch where contains(lower(caption), 'crane track')) select total, 50 as page_size, cast(ceil(total / 50) as bigint) as pages, case when 2 <= ceil(total / 50) then 2 else 0 end as page from t")
def browse_page_numbers(spark, sf_dir):
    return retrieval.page_numbers(retrieval.browse(chunks(spark, sf_dir, repeats=True), contains="crane track", repeats=True)[1], 2, 50)


@query(f"with {_CH} select chunk_id, start_us, end_us from ch where t_end >= timestamp '{T_FROM}' and t_start <= timestamp '{T_TO}'")
def overlap_filter(spark, sf_dir):
    return chunks(spark, sf_dir, t_from=T_FROM, t_to=T_TO).select("chunk_id", "start_us", "end_us")


def _ts(text: str):
    from datetime import datetime, timezone

    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)


def _us(text: str) -> int:
    return int(_ts(text).timestamp()) * 1_000_000


@query(f"with {_CH} select chunk_id from ch where t_end <= timestamp '{CUTOFF}'")
def select_before_cutoff(spark, sf_dir):
    return chunks(spark, sf_dir, where=f"t_end <= timestamp_ntz '{CUTOFF}'").select("chunk_id")


@query(f"""with {_CH}, i as (select chunk_id, row_number() over (order by chunk_id) as r from ch order by chunk_id limit 3),
w as (select chunk_id, unnest(case r when 1 then [2] when 2 then [1, 3] else [0] end) as pos from i)
select cast(pos as int) as pos, chunk_id, camera_id from w join ch using (chunk_id)""")
def fetch_by_ids_ordered(spark, sf_dir):
    c = chunks(spark, sf_dir)
    a, b, d = (r[0] for r in c.select("chunk_id").orderBy("chunk_id").limit(3).collect())
    return retrieval.fetch(c, [d, b, a, b, "no such chunk"]).select("pos", "chunk_id", "camera_id")


@query(f"with {_CH} select chunk_id, case when camera_id = 'cam01' then true else gated end as gated, case when camera_id = 'cam01' then 1 else 0 end as version from ch")
def upsert_keep_last(spark, sf_dir):
    c = chunks(spark, sf_dir).select("chunk_id", "camera_id", "gated").withColumn("version", F.lit(0))
    change = c.filter("camera_id = 'cam01'").withColumn("gated", F.lit(True)).withColumn("version", F.lit(1))
    return retrieval.upsert(c, [change]).select("chunk_id", "gated", "version")


@query(f"with {_CH} select count(*) filter (gated is not null and not gated) as left_rows, count(*) filter (coalesce(gated, true)) as deleted from ch")
def delete_semi_anti(spark, sf_dir):
    c = chunks(spark, sf_dir).select("chunk_id", "gated")
    doomed = c.filter(F.coalesce("gated", F.lit(True))).select("chunk_id").unionByName(spark.createDataFrame([("no such chunk",)], "chunk_id string"))
    left, gone = retrieval.delete(c, doomed)
    return left.agg(F.count(F.lit(1)).alias("left_rows")).crossJoin(gone)  # one row each


@query(f"""with {_CH}, p as (select chunk_id, case when coalesce(chunk_id, '') = '' then 'no id' when t_end < t_start then 'ends before it starts' when coalesce(segment, '') = '' then 'no segment'
  when gated and (coalesce(caption, '') <> '' or coalesce(len(embedding), 0) > 0) then 'gated with caption or vector'
  when not gated and coalesce(caption, '') = '' then 'no caption'
  when not gated and coalesce(len(embedding), 0) > 0 and len(embedding) <> 64 then 'vector of another length' end as problem from ch)
  select * from p where problem is not null""")
def contract_violations(spark, sf_dir):
    return retrieval.violations(chunks(spark, sf_dir, vectors=True))


# --- Retrieval ----------------------------------------------------------------------------------


def _seed_vector(spark, sf_dir) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == SEED_VECTOR_ID).head()["embedding"])


_SEED = f"(select embedding::double[] from embeddings where vec_id = {SEED_VECTOR_ID})"


@query(f"select vec_id, label, round(list_cosine_similarity(embedding::double[], {_SEED}), 6) as score from embeddings order by round(list_cosine_similarity(embedding::double[], {_SEED}), 6) desc, vec_id limit 20")
def cosine_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return retrieval.cosine_topk(e, _seed_vector(spark, sf_dir), id_col="vec_id", vec_col="embedding", k=20, digits=6).select("vec_id", "label", F.col("ann_score").alias("score"))


@query(f"select vec_id, round(list_cosine_similarity(embedding::double[], {_SEED}), 6) as score from embeddings where label = 3 order by 2 desc, vec_id limit 10")
def cosine_topk_filtered(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").filter("label = 3")
    return retrieval.cosine_topk(e, _seed_vector(spark, sf_dir), id_col="vec_id", vec_col="embedding", k=10, digits=6).select("vec_id", F.col("ann_score").alias("score"))


_CAND = f"""{_CH}, q as (select {_SEED} as v),
e as (select chunk_id, caption, t_end, case when sqrt(list_sum(list_transform(embedding, lambda x: x * x))) = 0 then 0 else list_cosine_similarity(embedding, v) end as s from ch, q where not gated and len(embedding) = 64 and tier = 'live'),
cand as (select *, round(s, 6) as ann_score from e order by ann_score desc, chunk_id limit 60),
terms as (select distinct unnest({_TOK.format("'" + QUESTION + "'")}) as t),
df as (select t, (select count(*) from cand where list_contains({_TOK.format('caption')}, t)) as d from terms),
w as (select t, ln(1 + (select count(*) from cand) / (1 + d)) as w from df),
rr as (select c.*, round((select sum(w) from w where list_contains({_TOK.format('c.caption')}, t)) / (select sum(w) from w), 6) as rs from cand c),
r as (select chunk_id, caption, t_end, ann_score, coalesce(rs, 0) as rerank_score from rr),
o as (select *, row_number() over (order by rerank_score desc, ann_score desc, chunk_id) as pos from r),
b as (select *, round(0.4 * case when max(rerank_score) over () > min(rerank_score) over () then (rerank_score - min(rerank_score) over ()) / (max(rerank_score) over () - min(rerank_score) over ()) else 0.5 end
   + 0.6 * power(0.5, (epoch_us(max(t_end) over ()) - epoch_us(t_end)) / 1e6 / 300), 6) as combined from o),
f as (select *, row_number() over (order by combined desc, pos) - 1 as rank from b)"""


def _candidates(spark, sf_dir) -> DataFrame:
    rows = chunks(spark, sf_dir, vectors=True, repeats=True, where="not gated and tier = 'live' and size(embedding) = 64")
    return retrieval.cosine_topk(rows, _seed_vector(spark, sf_dir), id_col="chunk_id", vec_col="embedding", k=60, digits=6, repeats=True)


_QWORDS = QUESTION.split()


@query(f"with {_CAND} select t as term, d as df, round(ln(1 + (select count(*) from cand) / (1 + d)), 6) as idf from df")
def idf_candidate_set(spark, sf_dir):
    c = _candidates(spark, sf_dir).select(tx.term_set("caption").alias("w")).cache()
    n = c.count()
    found = c.select(F.explode("w").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    q = spark.createDataFrame([(w,) for w in sorted(set(_QWORDS))], "term string")
    d = F.coalesce("df", F.lit(0))
    return q.join(found, "term", "left").select("term", d.alias("df"), F.round(F.log(1 + n / (1 + d)), 6).alias("idf"))


@query(f"with {_CAND} select chunk_id, ann_score, rerank_score from r")
def lexical_rerank(spark, sf_dir):
    return retrieval.lexical_rerank(_candidates(spark, sf_dir), _QWORDS, text_col="caption", digits=6).select("chunk_id", "ann_score", "rerank_score")


def _blended(spark, sf_dir) -> DataFrame:
    r = retrieval.lexical_rerank(_candidates(spark, sf_dir), _QWORDS, text_col="caption", digits=6)
    return retrieval.recency_blend(r, order=[F.desc("rerank_score"), F.desc("ann_score"), F.col("chunk_id")], options=retrieval.SearchOptions(digits=6))


@query(f"with {_CAND} select chunk_id, rerank_score, combined, rank from f")
def recency_blend(spark, sf_dir):
    return _blended(spark, sf_dir).select("chunk_id", "rerank_score", "combined", "rank")


@query(f"with {_CAND} select chunk_id, ann_score, rerank_score, combined, rank from f where rank < 5")
def hybrid_search(spark, sf_dir):
    o = retrieval.SearchOptions(digits=6)
    return retrieval.search(chunks(spark, sf_dir, vectors=True, repeats=True, where="size(embedding) = 64"), QUESTION, _seed_vector(spark, sf_dir), options=o, repeats=True).select("chunk_id", "ann_score", "rerank_score", "combined", "rank")


@query()
def hybrid_search_hashed(spark, sf_dir):
    """Search over documents with vectors made on the way by feature hashing."""
    d = table(spark, sf_dir, "documents").filter("text is not null").dropDuplicates(["doc_id"])
    rows = d.select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("written_at").cast("timestamp").alias("t_start"), F.col("written_at").cast("timestamp").alias("t_end"), F.lit("live").alias("tier"), F.lit(False).alias("gated"), F.col("text").alias("caption"), hash_embed(tx.tokenize("text"), 256).alias("embedding"))
    return retrieval.search(rows, QUESTION, dims=256).select("chunk_id", "ann_score", "rerank_score", "combined", "rank")


@query()
def hash_embed_norms(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", hash_embed(tx.tokenize(F.coalesce("text", F.lit(""))), 768).alias("e"))
    return d.select("doc_id", F.round(norm("e"), 6).alias("norm"))


@query(f"with {_CH} select segment, camera_id, min(start_us) as first_us, count(*) as n from ch where t_end > timestamp '{T_FROM}' and t_start < timestamp '{T_TO}' and coalesce(segment, '') <> '' group by 1, 2")
def segments_in_range_strip(spark, sf_dir):
    return timeline.strip(chunks(spark, sf_dir, t_from=T_FROM, t_to=T_TO), _ts(T_FROM), _ts(T_TO)).select("segment", "camera_id", F.unix_micros("first_start").alias("first_us"), "n")


# --- Text ---------------------------------------------------------------------------------------


@query(f"select doc_id, len({_TOK.format('text')}) as n_tokens, len(list_distinct({_TOK.format('text')})) as n_terms from documents where text is not null")
def token_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.size(tx.tokenize("text")).cast("long").alias("n_tokens"), F.size(tx.term_set("text")).cast("long").alias("n_terms"))


@query(f"with d as (select doc_id, {_TOK.format('text')} as w from documents where text is not null), b as (select w[i] || '_' || w[i + 1] as bigram from d, lateral (select unnest(range(1, len(w))) as i)) select bigram, count(*) as n from b group by 1")
def bigrams(spark, sf_dir):
    b = table(spark, sf_dir, "documents").filter("text is not null").select(F.explode(tx.bigrams("text")).alias("bigram"))
    return b.groupBy("bigram").agg(F.count(F.lit(1)).alias("n"))


@query(f"with d as (select doc_id, list_filter(list_distinct({_TOK.format('text')}), lambda w: not list_contains({tx.STOP_ANSWER}, w) and length(w) > 1) as w from documents where text is not null) select doc_id, len(w) as n_words, list_sort(w)[1:5] as first_words from d")
def content_words(spark, sf_dir):
    w = tx.answer_terms("text")
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.size(w).cast("long").alias("n_words"), F.slice(F.array_sort(w), 1, 5).alias("first_words"))


_HEDGE_SQL = " or ".join("contains(lower({c}), '" + h.replace("'", "''") + "')" for h in tx.HEDGES)


@query(f"select job_id, state, answer, coalesce({_HEDGE_SQL.format(c='answer')}, false) as hedged from jobs")
def hedge_flags(spark, sf_dir):
    return table(spark, sf_dir, "jobs").select("job_id", "state", "answer", tx.hedged("answer").alias("hedged"))


@query("select job_id, regexp_replace(regexp_extract(lower(answer), '^\\s*(\\S+)', 1), '^[.,:;!\"'']+|[.,:;!\"'']+$', '', 'g') = 'yes' as says_yes from jobs where answer is not null")
def verdict_parse(spark, sf_dir):
    return table(spark, sf_dir, "jobs").filter("answer is not null").select("job_id", tx.yes_no("answer").alias("says_yes"))


_GROUND = f"""with {_CH},
ctx as (select list_distinct(flatten(list({_TOK.format('caption')}))) as seen from ch where not gated and caption is not null and t_end >= timestamp '{T_FROM}' and t_start <= timestamp '{T_TO}'),
q as (select distinct job_id, question, list_filter(list_distinct({_TOK.format('question')}), lambda w: not list_contains({tx.STOP_ANSWER}, w) and length(w) > 1) as w from jobs where question is not null),
g as (select job_id, question, len(w) as n, len(list_intersect(w, seen)) as k, list_sort(list_filter(w, lambda x: list_contains({tx.DETAIL_TERMS}, x) and not list_contains(seen, x))) as missing from q, ctx)"""


def _grounding(spark, sf_dir) -> DataFrame:
    c = chunks(spark, sf_dir, where="not gated and caption is not null", t_from=T_FROM, t_to=T_TO)
    # The distinct words of the context: a vocabulary, gathered by a partial aggregate.
    seen = c.select(F.explode(tx.term_set("caption")).alias("w")).groupBy("w").count()
    q = table(spark, sf_dir, "jobs").filter("question is not null").select("job_id", "question").distinct()
    asked = q.select("job_id", "question", F.explode_outer(tx.answer_terms("question")).alias("w"))
    met = asked.join(seen.select("w", F.lit(True).alias("met")), "w", "left")
    detail = F.col("w").isin(tx.DETAIL_TERMS) & F.col("met").isNull()
    return met.groupBy("job_id", "question").agg(F.count("w").alias("n"), F.count("met").alias("k"), F.array_sort(F.collect_list(F.when(detail, F.col("w")))).alias("missing"))


@query(_GROUND + " select job_id, question, case when len(missing) > 0 then false else coalesce(k / nullif(n, 0), 0) >= 0.6 end as grounded, round(coalesce(k / nullif(n, 0), 0), 6) as coverage from g")
def groundedness_stub(spark, sf_dir):
    g = _grounding(spark, sf_dir)
    cov = health.ratio(F.col("k"), F.col("n"))
    return g.select("job_id", "question", F.when(F.size("missing") > 0, False).otherwise(cov >= 0.6).alias("grounded"), F.round(cov, 6).alias("coverage"))


@query(_GROUND + " select job_id, missing from g where len(missing) > 0")
def detail_terms_missing(spark, sf_dir):
    return _grounding(spark, sf_dir).filter(F.size("missing") > 0).select("job_id", "missing")


_DETAIL = f"""with {_CH}, tw as (select list_distinct(flatten(list({_TOK.format('describe_text')}))) as seen from tasks),
q as (select chunk_id, list_filter(list_distinct({_TOK.format('caption')}), lambda w: not list_contains({tx.STOP_ANSWER}, w) and length(w) > 1) as w from ch where caption is not null)
select chunk_id, list_sort(list_filter(w, lambda x: list_contains({tx.DETAIL_TERMS}, x) and not list_contains(seen, x))) as missing from q, tw where len(list_filter(w, lambda x: list_contains({tx.DETAIL_TERMS}, x) and not list_contains(seen, x))) > 0"""


@query(_DETAIL)
def caption_details_unasked(spark, sf_dir):
    """Words of fine detail in captions that no task's wording has."""
    seen = table(spark, sf_dir, "tasks").agg(F.array_distinct(F.flatten(F.collect_list(tx.tokenize("describe_text")))).alias("seen"))  # one row; the tasks are a fixed table
    c = chunks(spark, sf_dir, where="caption is not null").select("chunk_id", "caption").crossJoin(F.broadcast(seen))
    return c.select("chunk_id", tx.missing_details("caption", F.col("seen")).alias("missing")).filter(F.size("missing") > 0)


_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160) || chr(8195) || chr(8201) || chr(8202) || chr(8239) || chr(12288)"
_BARE = "regexp_replace({}, '^[\\s*•,;.-]+|[\\s*•,;.-]+$', '', 'g')"
_WORD = r"(not\s+present|not\s+visible|present|absent|yes|no)"
# The block is parsed line by line, as in the operator: one item with its verdict, or else any number of them.
_SPLIT = rf"""with {_CH}, c as (select chunk_id, caption, regexp_extract(caption, '(?is)^(.*?(?:^|[\s.;]))[\s*#>-]*watching\s*\**\s*:(.*)$', ['d', 'b']) as h from ch where caption is not null and caption <> ''),
l as (select chunk_id, unnest(string_split_regex(h.b, '\r\n|[\n\r]')) as line, generate_subscripts(string_split_regex(h.b, '\r\n|[\n\r]'), 1) as i from c where h.b <> ''),
v as (select *, regexp_extract(line, '(?i)^[\s*•\d.)-]*([^:\s](?:[^:]*?[^:\s])?)\s*[:—-]\s*\**{_WORD}\**\s*[.,]?\s*$', ['k', 'v']) as one from l),
e as (select chunk_id, i, 1 as j, regexp_replace(one.k, '^\*+|\*+$', '', 'g') as k, one.v as v from v where one.v <> ''
  union all select chunk_id, i, unnest(range(1, len(ks) + 1)), unnest(ks), unnest(vs) from (
    select chunk_id, i, list_transform(regexp_extract_all(line, '(?i)([^:;]+?)\s*[:—]\s*{_WORD}\b', 1), lambda x: {_BARE.format('x')}) as ks, regexp_extract_all(line, '(?i)([^:;]+?)\s*[:—]\s*{_WORD}\b', 2) as vs from v where one.v = '')),
w as (select chunk_id, k, case when lower(arg_max(v, row(i, j))) in ('present', 'yes') then 'present' else 'absent' end as v from e where k <> '' group by 1, 2),
s as (select chunk_id, list_sort(list(k || ': ' || v)) as items from w group by 1),
sp as (select chunk_id, case when items is not null and trim(h.d, {_BLANK}) <> '' then trim(h.d, {_BLANK}) else trim(caption, {_BLANK}) end as description, coalesce(items, []) as items from c left join s using (chunk_id))"""


def _split_captions(spark, sf_dir) -> DataFrame:
    c = chunks(spark, sf_dir, where="caption <> ''").select("chunk_id", tx.split_caption("caption").alias("p"))
    items = F.array_sort(F.transform(F.map_entries("p.watching"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    return c.select("chunk_id", F.col("p.description").alias("description"), items.alias("items"), F.size("p.watching").alias("n_items"))


@query(_SPLIT + " select chunk_id, description, len(items)::int as n_items from sp")
def caption_split(spark, sf_dir):
    return _split_captions(spark, sf_dir).drop("items")


@query(_SPLIT + " select chunk_id, description, items, len(items)::int as n_items from sp")
def caption_verdicts(spark, sf_dir):
    """Every caption, split, with the verdicts of its watch-list block."""
    return _split_captions(spark, sf_dir)


# --- Time ---------------------------------------------------------------------------------------


@query("with e as (select epoch_us(ts) as u from events), w as (select (u // 14400000000 - k) * 14400000000 as w_start, u from e, (select unnest([0, 1]) as k)) select w_start, count(*) as n from w where u >= w_start and u < w_start + 18000000000 group by 1")
def hop_windows(spark, sf_dir):
    return timeline.hop_counts(table(spark, sf_dir, "events"), F.col("ts").cast("timestamp"), "5 hours", "4 hours")


@query(f"with {_SEG}, w as (select path, start_us, unnest(range(0, (eff_end - start_us - 5000000) // 4000000 + 1)) as i from se where eff_end - start_us >= 5000000) select path, cast(i as bigint) as \"index\", start_us + i * 4000000 as w_start, start_us + i * 4000000 + 5000000 as w_end from w")
def hop_plan_sequence(spark, sf_dir):
    s = segments(spark, sf_dir).select("path", "start_us", F.col("eff_end").alias("end_us"))
    return timeline.plan_windows(s, 5, 4).select("path", "index", "w_start", "w_end")


@query(f"with {_SEG} select camera_id, path, start_us, eff_end, nominal from se")
def segment_effective_end(spark, sf_dir):
    return segments(spark, sf_dir).select("camera_id", "path", "start_us", "eff_end", "nominal")


def on_cameras(rows: DataFrame, spark, sf_dir, key: str = "req") -> DataFrame:
    """Adds ``camera_id``: every row to the camera whose number, in order of the archive's cameras, its key's hash gives."""
    # One row: the list of cameras, which the archive's layout bounds.
    cameras = segments(spark, sf_dir).agg(F.array_sort(F.collect_set("camera_id")).alias("_cameras"))
    number = F.conv(F.substring(F.md5(F.col(key)), 1, 6), 16, 10).cast("long")
    return rows.crossJoin(F.broadcast(cameras)).withColumn("camera_id", F.get("_cameras", F.pmod(number, F.size("_cameras")).cast("int"))).drop("_cameras")


def _requests(spark, sf_dir) -> DataFrame:
    """The footage ranges of all jobs, spread over all cameras."""
    j = table(spark, sf_dir, "jobs").select(F.col("job_id").alias("req"), micros("t_start").alias("t0"), micros("t_end").alias("t1")).dropDuplicates(["req"]).filter("t1 > t0")
    return on_cameras(j, spark, sf_dir).select("req", "camera_id", "t0", "t1")


def _tiles(spark, sf_dir) -> DataFrame:
    return timeline.tile_ranges(_requests(spark, sf_dir), segments(spark, sf_dir))


_TILE = f"""with {_SEG},
cams as (select list_sort(list(distinct camera_id)) as l from se),
rq as (select job_id as req, l[('0x' || md5(job_id)[1:6])::bigint % len(l) + 1] as camera_id, min(epoch_us(t_start)) as t0, min(epoch_us(t_end)) as t1 from jobs, cams group by 1, 2 having min(epoch_us(t_end)) > min(epoch_us(t_start))),
h as (select req, rq.camera_id, t0, t1, path, start_us, greatest(t0, start_us) as a, least(t1, eff_end) as z from rq join se on rq.camera_id = se.camera_id and start_us < t1 and eff_end > t0),
c as (select *, coalesce(max(z) over (partition by req order by start_us, path rows between unbounded preceding and 1 preceding), t0) as cur from h),
k as (select *, greatest(a, cur) as b from c where z > cur),
sp as (select req, camera_id, path, start_us as seg, b as span_start, z as span_end from k
  union all select req, camera_id, null, null, cur, b from k where b > cur
  union all select rq.req, rq.camera_id, null, null, coalesce(m, t0), t1 from rq left join (select req, max(z) as m from k group by 1) using (req) where coalesce(m, t0) < t1)"""


@query(_TILE + " select req, camera_id, path, span_start, span_end, (span_start - seg) / 1e6 as pts_in, (span_end - seg) / 1e6 as pts_out, path is null as is_gap from sp")
def range_tiling(spark, sf_dir):
    return _tiles(spark, sf_dir)


@query(_TILE + " select req, span_start, span_end from sp where path is null")
def tiling_gaps(spark, sf_dir):
    return _tiles(spark, sf_dir).filter("is_gap").select("req", "span_start", "span_end")


@query(_TILE + " select req, round(sum(case when path is null then 0 else (span_end - span_start) / 1e6 end), 6) as covered_s, round(sum(case when path is null then (span_end - span_start) / 1e6 else 0 end), 6) as gap_s from sp group by req")
def covered_seconds(spark, sf_dir):
    return timeline.covered_seconds(_tiles(spark, sf_dir))


@query(_TILE + " select req, count(*) as n_cuts, count(*) > 1 as joined, round(sum((span_end - span_start) / 1e6), 6) as seconds from sp where path is not null group by req")
def clip_plans(spark, sf_dir):
    p = timeline.clip_plan(_tiles(spark, sf_dir))
    total = F.aggregate("cuts", F.lit(0.0), lambda s, c: s + c["duration_s"])
    return p.select("req", F.col("n_cuts").cast("long").alias("n_cuts"), "joined", F.round(total, 6).alias("seconds"))


@query(f"""with {_SEG}, {_CH},
i as (select chunk_id as key, camera_id, start_us as t from ch where camera_id is not null and start_us is not null),
h as (select key, arg_max(path, row(s.start_us, path)) as path, max(s.start_us) as st from i join se s on i.camera_id = s.camera_id and s.start_us <= t and t < eff_end group by key)
select i.key, i.camera_id, i.t, h.path, (t - st) / 1e6 as pts_offset from i left join h on i.key = h.key""")
def segment_of_instant(spark, sf_dir):
    i = chunks(spark, sf_dir, where="camera_id is not null and t_start is not null").select(F.col("chunk_id").alias("key"), "camera_id", F.col("start_us").alias("t"))
    return timeline.segment_of_instant(i, segments(spark, sf_dir))


@query(f"with {_SEG}, n as (select *, count(*) over (partition by camera_id) as n, max(start_us) over (partition by camera_id) as newest from se) select camera_id, min(start_us) as start_us, max(eff_end) as end_us from n where n >= 2 and start_us < newest group by 1")
def archive_bounds(spark, sf_dir):
    return timeline.archive_bounds(segments(spark, sf_dir))


@query(f"with {_CH} select chunk_id, case when epoch_us(t_start) % 1000000 = 0 then strftime(t_start, '%Y-%m-%dT%H:%M:%SZ') else strftime(t_start, '%Y-%m-%dT%H:%M:%S.%fZ') end as iso from ch where t_start is not null")
def iso_format(spark, sf_dir):
    return chunks(spark, sf_dir, where="t_start is not null").select("chunk_id", tf.iso("t_start").alias("iso"))


@query(f"with {_CH} select chunk_id, camera_id || '_' || strftime(t_start, '%Y%m%dT%H%M%S') || '_' || strftime(t_end, '%H%M%S') as made from ch where camera_id is not null and t_start is not null and t_end is not null")
def chunk_id_format(spark, sf_dir):
    return chunks(spark, sf_dir, where="camera_id is not null and t_start is not null and t_end is not null").select("chunk_id", tf.chunk_id("camera_id", "t_start", "t_end").alias("made"))


@query("select cast(n as bigint) as attempt, least(60.0, power(2.0, n - 1)) as delay_s from range(1, 13) t(n)")
def backoff_ladder(spark, sf_dir):
    return spark.range(1, 13).select(F.col("id").alias("attempt"), tf.backoff(F.col("id")).alias("delay_s"))


@query("with a as (select * from actions qualify row_number() over (partition by entry_id order by ts) = 1) select entry_id, substring(regexp_replace(regexp_replace('spark-' || case when coalesce(task_id, '') = '' then 'ad-hoc' else task_id end || '-' || strftime(t_start, '%Y%m%dT%H%M%S') || '-' || strftime(t_end, '%Y%m%dT%H%M%S') || '-v1-discord', '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 128) as key from a where t_start is not null and t_end is not null")
def idempotency_keys(spark, sf_dir):
    a = table(spark, sf_dir, "actions").groupBy("entry_id").agg(F.min_by(F.struct("task_id", "t_start", "t_end"), "ts").alias("r"))
    a = a.select("entry_id", "r.*").filter("t_start is not null and t_end is not null")
    return a.select("entry_id", tf.idempotency_key(F.col("task_id"), F.col("t_start"), F.col("t_end")).alias("key"))


@query(f"with {_CH} select chunk_id, cast(('0x' || substring(sha256(chunk_id), 1, 2)) as int) % 8 as scene from ch")
def stub_scene_hash(spark, sf_dir):
    return chunks(spark, sf_dir).select("chunk_id", tf.scene_number(F.col("chunk_id")).alias("scene"))


@query(f"select t.task_id, e.event_id, case when a = z or (a = 0 and z = 1440) then true when a < z then m >= a and m < z else m >= a or m < z end as active from (select task_id, cast(active[1:2] as int) * 60 + cast(active[4:5] as int) as a, cast(active[7:8] as int) * 60 + cast(active[10:11] as int) as z from tasks) t, (select event_id, hour(l) * 60 + minute(l) as m from (select event_id, (ts at time zone 'UTC') at time zone '{ZONE}' as l from events)) e")
def active_hours(spark, sf_dir):
    """Whether each task is active at each event."""
    w = tf.active_minutes("active")
    t = table(spark, sf_dir, "tasks").select("task_id", w["start"].alias("a"), w["end"].alias("z"))
    e = table(spark, sf_dir, "events").select("event_id", tf.local_minute("ts", ZONE).alias("m")).crossJoin(F.broadcast(t))  # the standing tasks
    return e.select("task_id", "event_id", tf.minute_in(F.col("a"), F.col("z"), F.col("m")).alias("active"))


@query(f"select task_id, m as minute, count(*) as n from (select task_id, cast(active[1:2] as int) * 60 + cast(active[4:5] as int) as a, cast(active[7:8] as int) * 60 + cast(active[10:11] as int) as z from tasks) t, (select hour(l) * 60 + minute(l) as m from (select (ts at time zone 'UTC') at time zone '{ZONE}' as l from events)) e where a = z or (a = 0 and z = 1440) or case when a < z then m >= a and m < z else m >= a or m < z end group by 1, 2")
def active_minute_counts(spark, sf_dir):
    """Events met by each task, also those always active, per local minute of the day."""
    w = tf.active_minutes("active")
    t = table(spark, sf_dir, "tasks").select("task_id", w["start"].alias("a"), w["end"].alias("z"))
    e = table(spark, sf_dir, "events").select("ts").crossJoin(F.broadcast(t))  # the standing tasks
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), ZONE)
    met = e.filter(tf.minute_within(F.col("a"), F.col("z"), "ts", ZONE))
    return met.groupBy("task_id", (F.hour(local) * 60 + F.minute(local)).alias("minute")).agg(F.count(F.lit(1)).alias("n"))


# --- The motion gate, over small frames made of the vectors --------------------------------------


def _frames(spark, sf_dir) -> DataFrame:
    """Windows of five frames of 64 pixels, two cameras."""
    px = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x.cast("double") + 0.5) * 255).cast("int"))))
    e = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 2).alias("camera_id"), F.floor(F.col("vec_id") / 10).cast("long").alias("w_index"), "vec_id", px.alias("px"))
    return e.groupBy("camera_id", "w_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "px"))), lambda s: s["px"]).alias("frames"))


_FR = """with p as (select vec_id % 2 as camera_id, vec_id // 10 as w_index, vec_id, list_transform(embedding, lambda x: greatest(0, least(255, cast(floor((x::double + 0.5) * 255) as int)))) as px from embeddings),
x as (select *, lag(px) over (partition by camera_id order by vec_id) as ref, row_number() over (partition by camera_id, w_index order by vec_id) as f from p),
s as (select camera_id, w_index, vec_id, px, ref from x),
seq as (select camera_id, w_index, vec_id, px from s union all select camera_id, w_index, -1, ref from x where f = 1 and ref is not null),
u as (select camera_id, w_index, unnest(px) as v, unnest(range(64)) as i from seq),
mk as (select camera_id, w_index, i, max(v) - min(v) > 16 as live from u group by 1, 2, 3),
na as (select camera_id, w_index, count(*) filter (live) as active_px from mk group by 1, 2),
dd as (select camera_id, w_index, vec_id, unnest(px) as a, unnest(ref) as b, unnest(range(64)) as i from s where ref is not null),
ch as (select dd.camera_id, dd.w_index, vec_id, sum(abs(a - b)) as t from dd join mk on dd.camera_id = mk.camera_id and dd.w_index = mk.w_index and dd.i = mk.i and live group by 1, 2, 3),
sc as (select na.camera_id, na.w_index, active_px, case when active_px < 16 then 0 else round(max(t) / (active_px * 255), 9) end as score from na left join ch on na.camera_id = ch.camera_id and na.w_index = ch.w_index group by 1, 2, 3)"""


@query(_FR + " select camera_id, w_index, round(score, 6) as score from sc")
def motion_scores(spark, sf_dir):
    return gate.decide(_frames(spark, sf_dir)).select("camera_id", "w_index", F.round("score", 6).alias("score"))


@query(_FR + " select camera_id, w_index, active_px from sc")
def active_mask_counts(spark, sf_dir):
    return gate.decide(_frames(spark, sf_dir)).select("camera_id", "w_index", F.col("active_px").cast("long").alias("active_px"))


@query(_FR + " select camera_id, w_index, case when w_index < 2 then 'warmup' when active_px >= 16 and score >= 0.32 then 'motion' else 'still' end as reason from sc")
def gate_decisions(spark, sf_dir):
    return gate.decide(_frames(spark, sf_dir), threshold=0.32).select("camera_id", "w_index", "reason")
