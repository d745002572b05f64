"""Queries of jobs and the entries that wait for them, of ingest and of coverage, with the same in DuckDB's SQL.

The tables hold no turns of a conversation; an action's entry stands for one:
its task for the conversation, its reason for the answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.functions.keys import canon_id
from frameloom.operators import ingest, jobs, logs
from frameloom.plans.stream_queries import _CH, _SEG, _TILE, T_FROM, T_TO, _requests, chunks, segments
from frameloom.plans.watch_queries import _E, _J, latest_jobs, log

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


def _turns(spark, sf_dir) -> DataFrame:
    e = logs.entries(log(spark, sf_dir))
    return e.select(F.col("entry_id").alias("turn_id"), "ts", F.col("task_id").alias("conversation"), F.col("reason").alias("answer"), F.when(canon_id("job_id") != "", canon_id("job_id")).alias("job_id"))


_T = f"{_E}, {_J}, tu as (select entry_id as turn_id, ts, task_id as conversation, reason as answer, nullif(lower(trim(job_id)), '') as job_id from e), jk as (select lower(trim(job_id)) as job_id, state, answer from lj)"


def _jobs(spark, sf_dir) -> DataFrame:
    return latest_jobs(spark, sf_dir).select(canon_id("job_id").alias("job_id"), "state", "answer")


@query(f"with recursive {_T} select conversation, turn_id, ts from tu where conversation is not null qualify row_number() over (partition by conversation order by ts desc, turn_id desc) = 1")
def latest_turn_per_conversation(spark, sf_dir):
    return jobs.newest_per(_turns(spark, sf_dir).filter("conversation is not null"), "conversation", ["ts", "turn_id"]).select("conversation", "turn_id", "ts")


@query(f"with recursive {_T}, n as (select * from tu order by ts desc, turn_id desc limit 50) select turn_id, ts, state as job_state, case when state = 'done' and coalesce(jk.answer, '') <> '' then concat_ws(chr(10) || chr(10), n.answer, jk.answer) else n.answer end as answer from n left join jk on n.job_id = jk.job_id")
def recent_turns(spark, sf_dir):
    return jobs.chat_history(_turns(spark, sf_dir), _jobs(spark, sf_dir), most=50).select("turn_id", "ts", "job_state", "answer")


@query(f"with recursive {_T} select turn_id, state as job_state, case when state = 'done' and coalesce(jk.answer, '') <> '' then concat_ws(chr(10) || chr(10), tu.answer, jk.answer) else tu.answer end as answer from tu left join jk on tu.job_id = jk.job_id")
def answered_turns(spark, sf_dir):
    return jobs.answered_turns(_turns(spark, sf_dir), _jobs(spark, sf_dir)).select("turn_id", "job_state", "answer")


@query(f"with recursive {_T} select job_id, list(turn_id order by ts, turn_id) as turn_ids from tu where job_id is not null group by 1")
def jobs_with_turns(spark, sf_dir):
    return jobs.waiting_turns(_turns(spark, sf_dir))


@query(f"with {_J} select count(*) as submitted, count(*) filter (state = 'done') as done, count(*) filter (state = 'failed') as failed, count(*) filter (state = 'timeout') as timeout, count(*) filter (state not in ('done', 'failed', 'timeout')) as live from lj")
def worker_counters(spark, sf_dir):
    return jobs.worker_counters(latest_jobs(spark, sf_dir))


_PROBLEM = "case when start_us is null or end_us is null then 'a bound is missing' when end_us <= start_us then 'the range is empty' when trim(coalesce(question, '')) = '' then 'the question is empty' when end_us - start_us > 60000000 then printf('%.1f seconds are more than the 60 that one job may take', (end_us - start_us) / 1e6) end"


@query(f"with {_J}, x as (select job_id as req, end_us - start_us as l, {_PROBLEM} as error from lj) select req, error, case when error is null then 'queued' when l > 60000000 then 'failed' else 'refused' end as state from x")
def request_problems(spark, sf_dir):
    j = latest_jobs(spark, sf_dir).select(F.col("job_id").alias("req"), F.col("start_us").alias("t0"), F.col("end_us").alias("t1"), "question")
    return jobs.request_problems(j, most_s=60).select("req", "error", "state")


@query(
    _TILE
    + """, g as (select req, sum(span_end - span_start) filter (path is not null) as c, list({'start_us': span_start, 'end_us': span_end} order by span_start) filter (path is null) as gaps, count(distinct path) as files from sp group by 1)
select rq.req, (t1 - t0) / 1e6 as requested_s, round(coalesce(c, 0) / 1e6, 6) as covered_s, round(((t1 - t0) - coalesce(c, 0)) / 1e6, 6) as gap_s, len(coalesce(gaps, [])) as n_gaps, coalesce(gaps[1].start_us, 0) as first_gap_us, files as n_files, coalesce(c, 0) <= 0 as refused from rq join g using (req)"""
)
def coverage_record(spark, sf_dir):
    r = jobs.coverage_record(_requests(spark, sf_dir), segments(spark, sf_dir))
    return r.select("req", "requested_s", "covered_s", F.round("gap_s", 6).alias("gap_s"), F.size("gaps").cast("long").alias("n_gaps"), F.coalesce(F.get("gaps", F.lit(0))["start_us"], F.lit(0)).alias("first_gap_us"), F.size("segments").cast("long").alias("n_files"), "refused")


@query(f"with {_CH} select camera_id, arg_max(end_us, row(start_us, end_us)) as after_us from ch where start_us is not null and end_us is not null group by 1")
def resume_points(spark, sf_dir):
    return ingest.resume_points(chunks(spark, sf_dir, where="t_start is not null and t_end is not null"))


@query(
    f"""with {_CH}, {_SEG}, rs as (select camera_id, arg_max(end_us, row(start_us, end_us)) as after_us from ch where start_us is not null and end_us is not null and start_us < epoch_us(timestamp '{T_FROM}') group by 1),
cl as (select camera_id, start_us, eff_end from se qualify row_number() over (partition by camera_id order by start_us desc, path desc) > 1),
sn as (select camera_id, min(start_us) as a, max(eff_end) as z from cl group by 1),
w as (select camera_id, a, unnest(range(0, (z - a - 5000000) // 4000000 + 1)) as i from sn where z - a >= 5000000)
select w.camera_id, i as "index", a + i * 4000000 as w_start, a + i * 4000000 + 5000000 as w_end from w left join rs on w.camera_id = rs.camera_id where after_us is null or a + i * 4000000 >= after_us"""
)
def windows_to_do(spark, sf_dir):
    """The windows that an ingest run which had stopped in the first hours would still do."""
    done = chunks(spark, sf_dir, where=f"t_start < timestamp_ntz '{T_FROM}' and t_end is not null")
    return ingest.windows_to_do(segments(spark, sf_dir), ingest.resume_points(done), ingest.IngestSettings()).select("camera_id", "index", "w_start", "w_end")


@query(f"with {_CH} select count(*) as returned, min(start_us) as start_us, max(end_us) as end_us from ch where t_end >= timestamp '{T_FROM}' and t_start <= timestamp '{T_TO}'")
def span_of_hits(spark, sf_dir):
    s = jobs.span_of(chunks(spark, sf_dir, t_from=T_FROM, t_to=T_TO))
    return s.select("returned", F.unix_micros("t_start").alias("start_us"), F.unix_micros("t_end").alias("end_us"))


@query(f"with {_J} select job_id, (requested_us - (end_us - start_us)) // 1000000 * 1000000 as start_us, (requested_us - (end_us - start_us)) // 1000000 * 1000000 + (end_us - start_us) as end_us from lj where start_us is not null and end_us is not null and requested_us is not null")
def import_places(spark, sf_dir):
    """Where a recording as long as each job's range would lie, had it been imported at the time of the request."""
    j = latest_jobs(spark, sf_dir).filter("start_us is not null and end_us is not null and requested_us is not null")
    at = ingest.import_place((F.col("end_us") - F.col("start_us")) / 1e6, F.timestamp_micros("requested_us"))
    return j.select("job_id", at.alias("p")).select("job_id", F.unix_micros("p.t_start").alias("start_us"), F.unix_micros("p.t_end").alias("end_us"))
