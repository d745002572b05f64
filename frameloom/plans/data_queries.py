"""Queries of the general training-data operators, each over its whole tables, with the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.operators.changefeed import apply_feed, standing, state_table
from frameloom.operators.coverage import merge_intervals
from frameloom.operators.orphans import count_by_day, find_orphans
from frameloom.operators.sessions import SessionTable
from frameloom.plans.tables import action_feed, activity_events, coverage_intervals, reference_targets, references
from frameloom.session import cut


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_intervals(coverage_intervals(spark, sf_dir), ["src", "camera_id"])


def p2_found(spark: SparkSession, sf_dir: str, batches: int = 3) -> DataFrame:
    """The whole feed, applied in successive slices of time; rows without a time come with the first."""
    feed = action_feed(spark, sf_dir)
    table = state_table(spark)
    lo, hi = feed.agg(F.min("ts"), F.max("ts")).head()
    if lo is None:
        return standing(apply_feed(feed, table=table))
    width = (hi - lo) // batches + 1
    place = F.coalesce(F.floor((F.col("ts") - F.lit(lo)) / F.lit(width)), F.lit(0))
    for i in range(batches):
        apply_feed(feed.filter(place == i), table=table)
    return standing(table)


def _session_table(spark: SparkSession, sf_dir: str, batches: int = 3) -> SessionTable:
    """The whole table, applied in successive slices of time as a running engine would get it."""
    events = activity_events(spark, sf_dir)
    table = SessionTable(spark, gap_s=60)
    lo, hi = events.agg(F.min("t"), F.max("t")).head()
    if lo is None:
        return table
    width = (hi - lo) // batches + 1
    for i in range(batches):
        table.apply(events.filter((F.col("t") >= lo + i * width) & (F.col("t") < lo + (i + 1) * width)))
    return table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session_table(spark, sf_dir).read()
    return s.select(F.col("key").alias("camera_id"), F.col("first.id").alias("first_chunk_id"), F.col("last.id").alias("last_chunk_id"), F.col("n").alias("n_chunks"))


def p5_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session_table(spark, sf_dir).read()
    return s.select(F.col("key").alias("camera_id"), F.col("first.t").alias("start_us"), F.col("last.t").alias("end_us"), ((F.col("last.t") - F.col("first.t")) / 1e6).alias("duration_s"), F.col("n").alias("n_chunks"))


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_orphans(references(spark, sf_dir), reference_targets(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("src", "field", "rec_id", "state")


def p7_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_by_day(_orphans(spark, sf_dir))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p5_found, p5_sessions, p7_found, p7_by_day)}

_ID = "lower(trim({}))"
_FILE = "lower(trim(regexp_extract({}, '[^/]*$')))"
_SESSIONS = f"""
with e as (select distinct {_ID.format('camera_id')} as k, epoch_us(t_start) as t, chunk_id from chunks
           where gated = false and camera_id is not null and t_start is not null),
f as (select *, case when t - lag(t) over w <= 60000000 then 0 else 1 end as brk from e window w as (partition by k order by t, chunk_id)),
g as (select *, sum(brk) over (partition by k order by t, chunk_id rows unbounded preceding) as s from f)"""
_ORPHANS = f"""
with refs as (
  select distinct 'chunks' as src, 'segment' as field, chunk_id as rec_id, {_FILE.format('segment')} as key, epoch_us(t_start) as ts from chunks
  union all
  select 'actions', u.field, entry_id, u.key, ts from (
    select entry_id, epoch_us(ts) as ts, {_ID.format('task_id')} as task_id, {_ID.format('job_id')} as job_id, {_FILE.format('clip_path')} as clip_path
    from actions qualify row_number() over (partition by entry_id order by ts) = 1) a,
    lateral (select unnest(['task_id', 'job_id', 'clip_path']) as field, unnest([task_id, job_id, clip_path]) as key) u),
gone as (select distinct {_FILE.format('path')} as key from removed_files),
ret as (select {_ID.format('task_id')} as key, min(epoch_us(retired_at)) as at from retired_tasks group by 1),
tgt as (
  select 'segment' as field, {_FILE.format('path')} as key, null::bigint as since from segments
  union all select 'task_id', {_ID.format('task_id')}, null from tasks
  union all select 'job_id', {_ID.format('job_id')}, epoch_us(requested_at) from jobs
  union all select 'clip_path', {_FILE.format('path')}, epoch_us(mtime) from clips),
t as (select field, key, min(since) as since from tgt group by 1, 2),
o as (
  select r.src, r.field, r.rec_id, r.ts,
    case when r.field in ('segment', 'clip_path') and gone.key is not null then 'removed'
         when r.field = 'task_id' and ret.key is not null then case when ret.at <= r.ts then 'removed' end
         when t.key is null then 'missing'
         when t.since > r.ts then 'late' end as state
  from refs r left join t on r.field = t.field and r.key = t.key left join gone on r.key = gone.key left join ret on r.key = ret.key
  where r.key is not null and r.key <> '')"""

ORACLE = {
    "p1_found": f"""
with i as (
  select 'chunks' as src, {_ID.format('camera_id')} as camera_id, epoch_us(t_start) as s, epoch_us(t_end) as e from chunks
  union all select 'segments', {_ID.format('camera_id')}, epoch_us(seg_start), epoch_us(seg_end) from segments),
p as (select *, max(e) over (partition by src, camera_id order by s, e rows between unbounded preceding and 1 preceding) as m
      from i where camera_id is not null and e > s),
g as (select *, sum(case when m is null or s > m + 2000000 then 1 else 0 end) over (partition by src, camera_id order by s, e rows unbounded preceding) as k from p),
pr as (select src, camera_id, k, min(s) as start_us, max(e) as end_us from g group by 1, 2, 3),
gp as (select src, camera_id, end_us as start_us, lead(start_us) over (partition by src, camera_id order by start_us) as end_us from pr)
select src, camera_id, 'period' as kind, start_us, end_us from pr
union all select src, camera_id, 'gap', start_us, end_us from gp where end_us - start_us <= 21600000000""",
    "p2_found": """
with recursive e as (select entry_id, parent_id, status, ts from actions qualify row_number() over (partition by entry_id order by ts) = 1),
r(entry_id, root, ts, status) as (
  select entry_id, entry_id, ts, status from e where parent_id is null
  union all select e.entry_id, r.root, e.ts, e.status from e join r on e.parent_id = r.entry_id),
l as (select root, entry_id, status from r qualify row_number() over (partition by root order by ts desc, entry_id desc) = 1)
select root as entry_id, entry_id as last_entry_id from l where status <> 'retracted'""",
    "p5_found": _SESSIONS + """
select k as camera_id, arg_min(chunk_id, row(t, chunk_id)) as first_chunk_id, arg_max(chunk_id, row(t, chunk_id)) as last_chunk_id, count(*) as n_chunks from g group by k, s""",
    "p5_sessions": _SESSIONS + """
select k as camera_id, min(t) as start_us, max(t) as end_us, (max(t) - min(t)) / 1e6 as duration_s, count(*) as n_chunks from g group by k, s""",
    "p7_found": _ORPHANS + " select src, field, rec_id, state from o where state is not null",
    "p7_by_day": _ORPHANS + " select src, field, state, make_timestamp(ts)::date as day, count(*) as n from o where state is not null group by 1, 2, 3, 4",
}
