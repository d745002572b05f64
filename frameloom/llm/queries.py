"""Queries of the operators for language-model data, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.functions.keys import canon_id, micros
from frameloom.llm.bpe import encode_corpus
from frameloom.llm.graph_search import greedy_search
from frameloom.llm.leakage import find_leaks
from frameloom.llm.neardup import linked_records, similar_texts
from frameloom.llm.nndescent import NeighbourGraph, close_pairs
from frameloom.llm.runs import event_runs
from frameloom.llm.splitting import split_corpus


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "chunks")
    return event_runs(c.select(canon_id("camera_id").alias("key"), micros("t_start").alias("t"), F.col("chunk_id").alias("id"), "gated", micros("t_end").alias("t_end"), "caption"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).select(F.col("key").alias("camera_id"), F.col("first_id").alias("first_chunk_id"), F.col("last_id").alias("last_chunk_id"), F.col("n").alias("n_chunks"))


def p3_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).select(F.col("key").alias("camera_id"), "start_us", "end_us", "duration_s", F.col("n").alias("n_chunks"), "gated")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = linked_records(_table(spark, sf_dir, "chunks"), "chunk_id", "caption")
    return pairs.select(F.col("id_a").alias("chunk_a"), F.col("id_b").alias("chunk_b"))


def _graph(spark: SparkSession, sf_dir: str) -> NeighbourGraph:
    return NeighbourGraph(_table(spark, sf_dir, "chunks").select(F.col("chunk_id").alias("rec"), F.col("embedding").alias("v")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return close_pairs(_graph(spark, sf_dir)).select(F.col("a").alias("chunk_a"), F.col("b").alias("chunk_b"))


def p6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).neighbours().select(F.col("a").alias("chunk_id"), F.col("b").alias("neighbour_id"), "rank", "cosine")


def p6_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose record's hash is divisible by 100, against all vectors, by walking the graph."""
    g = _graph(spark, sf_dir)
    queries = g.vectors.join(g.nodes.filter("pmod(xxhash64(rec), 100) = 0").select("rec"), "rec", "left_semi")
    return greedy_search(g, queries).select(F.col("a").alias("chunk_id"), F.col("b").alias("neighbour_id"), "rank", "cosine")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(_table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"), paraphrases=False)
    return leaks.filter("kind = 'exact'").select("doc_id", "item_id")


def p9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"))


def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_corpus(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p3_found, p3_runs, p4_found, p6_found, p6_neighbours, p6_search, p8_ids, p9_found, p9_leaks, p10_pieces)}

_WORDS = "list_distinct(regexp_extract_all(lower(caption), '[\\p{L}\\p{N}]+'))"

_RUNS = f"""
with c as (select distinct lower(trim(camera_id)) as k, epoch_us(t_start) as t, epoch_us(t_end) as z, chunk_id, gated, {_WORDS} as w from chunks
           where camera_id is not null and t_start is not null and gated is not null),
p as (select *, lag(t) over o as pt, lag(gated) over o as pg, lag(w) over o as pw from c window o as (partition by k order by t, chunk_id)),
b as (select *, case when t - pt <= 600000000 and gated = pg and (gated or (len(w) > 0 and len(pw) > 0
        and 10 * len(list_intersect(w, pw)) >= 7 * (len(w) + len(pw) - len(list_intersect(w, pw))))) then 0 else 1 end as brk from p),
g as (select *, sum(brk) over (partition by k order by t, chunk_id rows unbounded preceding) as r from b)"""

ORACLE = {
    "p3_found": _RUNS + """
select k as camera_id, arg_min(chunk_id, row(t, chunk_id)) as first_chunk_id, arg_max(chunk_id, row(t, chunk_id)) as last_chunk_id, count(*) as n_chunks
from g group by k, r having count(*) >= 2""",
    "p3_runs": _RUNS + """
select k as camera_id, min(t) as start_us, max(z) as end_us, (max(z) - min(t)) / 1e6 as duration_s, count(*) as n_chunks, bool_or(gated) as gated
from g group by k, r having count(*) >= 2""",
    "p9_found": """
with d as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from documents where text is not null),
i as (select item_id, regexp_extract_all(lower(item_text), '[\\p{L}\\p{N}]+') as w from eval_items),
gd as (select doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) as g from d where len(w) >= 12),
gi as (select item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) as g from i where len(w) >= 12)
select distinct doc_id, item_id from gd join gi using (g)""",
    # Every vector against every other.
    "p6_found": """
with v as (select chunk_id, any_value(embedding) as e from chunks where chunk_id is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null)) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0 group by 1),
c as (select a.chunk_id as x, b.chunk_id as y, list_cosine_similarity(a.e, b.e) as s from v a, v b where a.chunk_id <> b.chunk_id),
t as (select * from c qualify row_number() over (partition by x order by s desc, y) <= 5)
select distinct least(x, y) as chunk_a, greatest(x, y) as chunk_b from t where s >= 0.9""",
    # The pairs of distinct captions that share one of the words a pair must share; too slow for SQL beyond the smaller sizes.
    "p4_found": f"""
with c as (select caption, {_WORDS} as w from (select distinct caption from chunks where caption is not null) where len({_WORDS}) > 0),
n as (select row_number() over (order by caption) as i, caption, w from c),
x as (select i, unnest(w) as t from n),
df as (select t, count(*) as f from x group by t),
o as (select x.i, x.t, row_number() over (partition by x.i order by f, x.t) as p, count(*) over (partition by x.i) as s from x join df using (t)),
pre as (select i, t from o where p <= s - ceil(0.7 * s - 1e-9) + 1),
cand as (select distinct a.i as i, b.i as j from pre a join pre b on a.t = b.t and a.i < b.i),
ok as (select n1.caption as ca, n2.caption as cb from cand join n n1 on cand.i = n1.i join n n2 on cand.j = n2.i
       where 10 * len(list_intersect(n1.w, n2.w)) >= 7 * (len(n1.w) + len(n2.w) - len(list_intersect(n1.w, n2.w)))),
o1 as (select distinct chunk_id, caption from chunks where chunk_id is not null)
select distinct least(a.chunk_id, b.chunk_id) as chunk_a, greatest(a.chunk_id, b.chunk_id) as chunk_b
from ok join o1 a on ok.ca = a.caption join o1 b on ok.cb = b.caption where a.chunk_id <> b.chunk_id""",
}
