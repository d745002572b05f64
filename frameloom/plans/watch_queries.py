"""Queries of the action log, the jobs, the funnel, retention and scheduling, with the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.functions import text as tx
from frameloom.functions import timefmt as tf
from frameloom.functions.keys import canon_id, micros
from frameloom.operators import funnel, health, logs, scheduling, timeline
from frameloom.plans.stream_queries import _CH, _SEG, _TOK, CUTOFF, ZONE, _us, chunks, on_cameras, segments
from frameloom.plans.tables import table
from frameloom.session import scratch_path
from frameloom.streaming import funnel as live

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


# --- The action log -----------------------------------------------------------------------------


def log(spark, sf_dir) -> DataFrame:
    a = table(spark, sf_dir, "actions")
    return a.select("entry_id", micros("ts").alias("ts"), "action", micros("t_start").alias("t_start"), micros("t_end").alias("t_end"), "status", canon_id("task_id").alias("task_id"), "reason", "clip_path", "parent_id", "job_id")


_E = """e as (select entry_id, epoch_us(ts) as ts, action, epoch_us(t_start) as t_start, epoch_us(t_end) as t_end, status, lower(trim(task_id)) as task_id, reason, clip_path, parent_id, job_id
  from actions qualify row_number() over (partition by entry_id order by ts) = 1),
led(entry_id, root) as (select entry_id, entry_id from e where parent_id is null union all select e.entry_id, led.root from e join led on e.parent_id = led.entry_id),
r as (select e.*, coalesce(led.root, e.entry_id) as root from e left join led on e.entry_id = led.entry_id),
fo as (select root, max(action) filter (entry_id = root) as action, max(task_id) filter (entry_id = root) as task_id, max(ts) filter (entry_id = root) as acted_at, count(*) - 1 as n_amendments,
  arg_max(status, row(ts, entry_id)) as status, max(ts) as resolved_at,
  arg_max(clip_path, row(ts, entry_id)) filter (coalesce(clip_path, '') <> '') as clip_path, arg_max(job_id, row(ts, entry_id)) filter (coalesce(job_id, '') <> '') as job_id,
  coalesce(arg_max(reason, row(ts, entry_id)) filter (coalesce(reason, '') <> ''), '') as reason from r group by root)"""


@query(f"with recursive {_E} select * from fo")
def amendment_fold(spark, sf_dir):
    return logs.fold(log(spark, sf_dir))


@query(f"with recursive {_E} select status, action, count(*) as n from fo group by 1, 2")
def resolved_status(spark, sf_dir):
    return logs.fold(log(spark, sf_dir)).groupBy("status", "action").agg(F.count(F.lit(1)).alias("n"))


@query(f"with recursive {_E} select root, action, acted_at from fo where action <> 'save_clip' and status = 'unverified'")
def pending_verification(spark, sf_dir):
    return logs.pending_verification(logs.fold(log(spark, sf_dir))).select("root", "action", "acted_at")


@query(f"with recursive {_E} select entry_id, root from r")
def amendment_chain_recursive(spark, sf_dir):
    return logs.with_roots(log(spark, sf_dir)).select("entry_id", "root")


_A, _Z = "2026-01-05 03:00:00", "2026-01-05 03:30:00"


@query(f"with recursive {_E}, hit as (select distinct root from r where (ts between {_us(_A)} and {_us(_Z)}) or (t_start < {_us(_Z)} and t_end > {_us(_A)})) select entry_id, root, ts, status from r where root in (select root from hit)")
def action_log_range(spark, sf_dir):
    return logs.range_read(log(spark, sf_dir), _us(_A), _us(_Z)).select("entry_id", "root", "ts", "status")


@query(f"""with recursive {_E}, k as (select e.*, p.entry_id as pid from e left join e p on e.parent_id = p.entry_id),
kid as (select pid, arg_max(status, row(ts, entry_id)) as status from k where pid is not null group by 1),
t as (select strftime((make_timestamp(ts) at time zone 'UTC') at time zone '{ZONE}', '%Y-%m-%d') as day, coalesce(kid.status, k.status) as final from k left join kid on kid.pid = k.entry_id where k.pid is null)
select day, count(*) as n_actions, count(*) filter (final = 'retracted') as n_retracted from t group by 1""")
def timeline_by_local_day(spark, sf_dir):
    return logs.timeline(log(spark, sf_dir), ZONE)


@query(f"with recursive {_E} select task_id, max(ts) as last_fired from e where parent_id is null and task_id is not null group by 1")
def last_fired_by_task(spark, sf_dir):
    return logs.last_fired(log(spark, sf_dir))


@query(f"with recursive {_E}, c as (select e.entry_id as parent_id, 'amend-' || e.entry_id as entry_id, e.action, e.task_id, e.t_start from e where parent_id is null and status = 'unverified') select * from c")
def amend_rows(spark, sf_dir):
    a = log(spark, sf_dir)
    one = logs.entries(a).filter("parent_id is null and status = 'unverified'")
    change = one.select(F.col("entry_id").alias("parent_id"), F.concat(F.lit("amend-"), "entry_id").alias("entry_id"), F.col("ts"), F.lit("verified").alias("status"), F.lit("checked").alias("reason"))
    return logs.amend(a, change).select("parent_id", "entry_id", "action", "task_id", "t_start")


# --- Jobs ---------------------------------------------------------------------------------------


def job_rows(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "jobs").select("job_id", micros("t_start").alias("start_us"), micros("t_end").alias("end_us"), "question", "state", micros("requested_at").alias("requested_us"), micros("completed_at").alias("completed_us"), "answer", "confidence").withColumn("rank", logs.job_rank(F.col("state")))


def latest_jobs(spark, sf_dir) -> DataFrame:
    return logs.latest_by(job_rows(spark, sf_dir), "job_id", ["rank", "completed_us", "state", "answer", "confidence"])


_J = """j as (select job_id, epoch_us(t_start) as start_us, epoch_us(t_end) as end_us, question, state, epoch_us(requested_at) as requested_us, epoch_us(completed_at) as completed_us, answer, confidence,
  case state when 'queued' then 0 when 'running' then 1 when 'done' then 2 when 'timeout' then 3 when 'failed' then 4 else -1 end as rank from jobs),
lj as (select * from j qualify row_number() over (partition by job_id order by rank desc, completed_us desc nulls last, state desc, answer desc nulls last, confidence desc nulls last) = 1)"""


@query(f"with {_J} select job_id, state, requested_us, completed_us, confidence from lj")
def latest_job_states(spark, sf_dir):
    return latest_jobs(spark, sf_dir).select("job_id", "state", "requested_us", "completed_us", "confidence")


@query(f"with {_J} select job_id, state from lj where state in ('queued', 'running')")
def unfinished_jobs(spark, sf_dir):
    return logs.unfinished(latest_jobs(spark, sf_dir)).select("job_id", "state")


@query(f"with {_J} select job_id, requested_us from lj order by requested_us desc, job_id desc limit 50")
def recent_jobs(spark, sf_dir):
    return health.newest(latest_jobs(spark, sf_dir).select("job_id", "requested_us"), 50, ["requested_us", "job_id"])


@query(f"with recursive {_E}, {_J} select lj.job_id, lj.state, count(e.entry_id) as n_entries, list_sort(list(e.entry_id) filter (e.entry_id is not null)) as entries from lj left join e on lower(trim(e.job_id)) = lower(trim(lj.job_id)) group by 1, 2")
def jobs_with_entries(spark, sf_dir):
    e = logs.entries(log(spark, sf_dir)).select(canon_id("job_id").alias("k"), "entry_id")
    j = latest_jobs(spark, sf_dir).select("job_id", "state", canon_id("job_id").alias("k"))
    return j.join(e, "k", "left").groupBy("job_id", "state").agg(F.count("entry_id").alias("n_entries"), F.array_sort(F.collect_list("entry_id")).alias("entries")).select("job_id", "state", "n_entries", F.when(F.size("entries") > 0, F.col("entries")).alias("entries"))


@query(f"with {_J} select job_id, case when state = 'done' and confidence is not null then case when confidence >= 0.5 then 'verified' else 'retracted' end end as verdict from lj")
def verification_verdicts(spark, sf_dir):
    return latest_jobs(spark, sf_dir).select("job_id", health.verdict(F.col("state"), F.col("confidence")).alias("verdict"))


_TILED = f"""{_SEG}, {_J}, cams as (select list_sort(list(distinct camera_id)) as l from se),
rq as (select job_id, l[('0x' || md5(job_id)[1:6])::bigint % len(l) + 1] as cam, start_us as t0, end_us as t1, answer from lj, cams where end_us > start_us),
cv as (select job_id, coalesce(sum(greatest(0, least(t1, eff_end) - greatest(t0, s.start_us))) filter (s.path is not null), 0) / 1e6 as covered from rq left join se s on s.camera_id = rq.cam and s.start_us < t1 and s.eff_end > t0 group by 1)"""


@query(f"with {_TILED}, x as (select job_id, (t1 - t0) / 1e6 as asked, covered, greatest(1, cast(round_even((t1 - t0) / 1e6 * 0.4, 0) as int)) as expected, coalesce({' or '.join(chr(40) + 'contains(lower(answer), ' + chr(39) + h.replace(chr(39), chr(39) * 2) + chr(39) + ')' + chr(41) for h in tx.HEDGES)}, false) as hedged from rq join cv using (job_id)) select job_id, expected, round(case when hedged then 0.35 else 1 end * least(1, covered / asked), 4) as confidence from x")
def confidence_coverage(spark, sf_dir):
    j = latest_jobs(spark, sf_dir).filter("end_us > start_us")
    req = on_cameras(j.select(F.col("job_id").alias("req"), F.col("start_us").alias("t0"), F.col("end_us").alias("t1")), spark, sf_dir)
    cov = timeline.covered_seconds(timeline.tile_ranges(req, segments(spark, sf_dir)))
    asked = (F.col("end_us") - F.col("start_us")) / 1e6
    x = j.join(cov, j["job_id"] == cov["req"]).withColumn("asked", asked).withColumn("expected", health.expected_frames(F.col("asked"), 0.4))
    return x.select("job_id", "expected", health.confidence(F.col("asked"), F.col("covered_s"), F.col("expected"), F.col("expected"), tx.hedged("answer")).alias("confidence"))


@query(f"with {_CH}, h as (select segment, min(start_us) - 5000000 as a, max(end_us) + 5000000 as z from ch where not gated and coalesce(segment, '') <> '' group by 1) select segment, greatest(a, z - 15000000) as t0, z as t1, z - a > 15000000 as clamped from h")
def deep_range_selection(spark, sf_dir):
    """The range to watch again for the windows of each segment: padded, and clamped to its end."""
    c = chunks(spark, sf_dir, where="not gated").filter("coalesce(segment, '') <> ''")
    pad, most = 5 * funnel.US, 15 * funnel.US
    h = c.groupBy("segment").agg((F.min("start_us") - pad).alias("a"), (F.max("end_us") + pad).alias("z"))
    return h.select("segment", F.greatest("a", F.col("z") - most).alias("t0"), F.col("z").alias("t1"), (F.col("z") - F.col("a") > most).alias("clamped"))


@query(f"with {_J}, x as (select state, (completed_us - requested_us) / 1e6 as s from lj where completed_us is not null) select state, min(s) as best, median(s) as median, quantile_cont(s, 0.95) as p95, count(s) as n from x group by 1")
def bench_percentiles(spark, sf_dir):
    j = latest_jobs(spark, sf_dir).filter("completed_us is not null").withColumn("s", (F.col("completed_us") - F.col("requested_us")) / 1e6)
    return health.bench_figures(j, "s", ["state"])


# --- Retention ----------------------------------------------------------------------------------

_NOW = _us(CUTOFF) + 10_800 * funnel.US
_PLAN = f"""{_SEG}, pl as (select *, row_number() over (partition by camera_id order by start_us desc, path desc) = 1 as newest from se),
rp as (select camera_id, path, start_us, eff_end, not newest and coalesce(mtime_us, 0) <= {_NOW} - 120000000 as doomed, size_bytes from pl where eff_end <= {_us(CUTOFF)})"""


@query(f"with {_PLAN} select camera_id, path, start_us, doomed from rp")
def retention_plan_rows(spark, sf_dir):
    return health.retention_plan(segments(spark, sf_dir), now_us=_NOW).select("camera_id", "path", "start_us", "doomed")


@query(f"with {_PLAN} select cast(coalesce(sum(size_bytes) filter (doomed), 0) as bigint) as bytes, count(*) filter (doomed) as files, count(*) filter (not doomed) as kept from rp")
def retention_plan_totals(spark, sf_dir):
    return health.retention_totals(health.retention_plan(segments(spark, sf_dir), now_us=_NOW))


@query(f"with {_J} select job_id from lj where state in ('queued', 'running') and start_us < {_us(CUTOFF)}")
def retention_blocked(spark, sf_dir):
    return health.retention_blockers(latest_jobs(spark, sf_dir), now_us=_NOW).select("job_id")


@query(f"with {_J} select distinct job_id from j where state in ('queued', 'running') and start_us < {_us(CUTOFF)}")
def retention_blocked_then(spark, sf_dir):
    """The jobs that would have held the deletion back while they were under way."""
    under_way = job_rows(spark, sf_dir).filter("state in ('queued', 'running')")
    return health.retention_blockers(under_way, now_us=_NOW).select("job_id").distinct()


@query(f"with {_CH} select camera_id, ({_NOW} - max(end_us)) / 1e6 as age_s from ch group by 1")
def freshness(spark, sf_dir):
    return health.freshness(chunks(spark, sf_dir), _NOW)


@query(f"with {_CH}, u as (select distinct cast(regexp_extract(camera_id, '^clip(\\d+)$', 1) as bigint) as k from ch where regexp_matches(camera_id, '^clip\\d+$')) select 'clip' || lpad(cast(min(k + 1) as varchar), 2, '0') as name from (select k from u union all select 0) where k + 1 not in (select k from u)")
def next_free_camera(spark, sf_dir):
    return health.next_free_name(chunks(spark, sf_dir).select("camera_id").distinct())


# --- The funnel ---------------------------------------------------------------------------------


def tasks(spark, sf_dir) -> DataFrame:
    t = table(spark, sf_dir, "tasks")
    return t.select(canon_id("task_id").alias("task_id"), "describe_text", "window_s", "action", "cooldown", "active", "enabled", F.col("embedding").alias("task_embedding"))


_O = funnel.FunnelOptions()


def _stream(spark, sf_dir) -> DataFrame:
    return chunks(spark, sf_dir, vectors=True, where="t_start is not null and t_end is not null")


def _staged(spark, sf_dir) -> DataFrame:
    return funnel.stage_columns(funnel.pair_with_tasks(_stream(spark, sf_dir), tasks(spark, sf_dir), _O), _O)


_FU = f"""{_CH},
tk as (select lower(trim(task_id)) as task_id, describe_text, window_s, action, cooldown, enabled, embedding as te, list_filter(list_distinct({_TOK.format('describe_text')}), lambda w: not list_contains({tx.STOP_CONFIRM}, w)) as want,
  cast(active[1:2] as int) * 60 + cast(active[4:5] as int) as a, cast(active[7:8] as int) * 60 + cast(active[10:11] as int) as z from tasks),
cc as (select *, hour(l) * 60 + minute(l) as m, {_TOK.format("coalesce(caption, '')")} as cw from (select *, (t_start at time zone 'UTC') at time zone '{ZONE}' as l from ch where start_us is not null and end_us is not null)),
pr as (select chunk_id, t_start, start_us, end_us, task_id, window_s, action, cooldown,
  enabled and case when a = z or (a = 0 and z = 1440) then true when a < z then m >= a and m < z else m >= a or m < z end as awake,
  not coalesce(gated, true) and coalesce(caption, '') <> '' as seen,
  case when len(te) = len(embedding) and len(te) > 0 and list_sum(list_transform(embedding, lambda x: x * x)) > 0 and list_sum(list_transform(te, lambda x: x * x)) > 0 then round(list_cosine_similarity(te, embedding), 9) else 0 end as score,
  case when len(want) = 0 then 0 else len(list_intersect(want, cw)) / len(want) end as cov from cc, tk),
st as materialized (select *, awake and seen and score >= 0.15 as s1, awake and seen and score >= 0.15 and cov >= 0.5 as ok from pr)"""
_RUNS = f"""{_FU},
ru as (select *, sum(case when ok then 0 else 1 end) over (partition by task_id order by t_start, chunk_id rows unbounded preceding) as run from st),
hi as (select *, min(start_us) over (partition by task_id, run) as since from ru where ok),
rq as (select *, (end_us - since) / 1e6 as held_s from hi),
req as (select *, row_number() over (partition by task_id, run order by t_start, chunk_id) as nth from rq where held_s >= window_s)"""


@query(f"with {_FU} select chunk_id, task_id, round(score, 6) as score from st where s1")
def stage1_candidates(spark, sf_dir):
    return _staged(spark, sf_dir).filter("stage1").select("chunk_id", "task_id", F.round("stage1_score", 6).alias("score"))


@query(f"with {_FU} select task_id, count(*) as pairs, count(*) filter (awake) as awake, count(*) filter (s1) as stage1, count(*) filter (ok) as stage2 from st group by 1")
def funnel_counters(spark, sf_dir):
    return funnel.counters(_staged(spark, sf_dir))


def _sustained(spark, sf_dir) -> DataFrame:
    return funnel.sustained(_staged(spark, sf_dir), _O, stream=_stream(spark, sf_dir))


@query(f"with {_RUNS} select task_id, run as run_no, min(since) as since_us, max(end_us) as until_us, count(*) as n from rq group by 1, 2")
def sustained_runs(spark, sf_dir):
    r = _sustained(spark, sf_dir).groupBy("task_id", "run").agg(F.unix_micros(F.min("run_since")).alias("since_us"), F.max("end_us").alias("until_us"), F.count(F.lit(1)).alias("n"))
    return r.withColumnRenamed("run", "run_no")


@query(f"with {_RUNS} select task_id, chunk_id, held_s from req where nth = 1")
def promotions(spark, sf_dir):
    return _sustained(spark, sf_dir).filter("promoted").select("task_id", "chunk_id", "held_s")


def _fires(cooldown: str, pad: str) -> str:
    """Requests decided one after the other; collisions only need the latest ends, as starts rise."""
    return f"""with recursive {_RUNS},
q as materialized (select task_id || '|' || action as key, since as t0, end_us as t1, chunk_id || '|' || task_id as id, end_us as act, cooldown * 1000000 as cd, row_number() over (partition by task_id, action order by since, chunk_id || '|' || task_id) as i from req),
d as (select key, i, t0, t1, id, act, false as dedupe, false as cooldown, act as last, [struct_pack(a := t0, z := t1)] as fired from q where i = 1
  union all
  select q.key, q.i, q.t0, q.t1, q.id, q.act, x.dd, x.cc, case when x.dd or x.cc then d.last else greatest(d.last, q.act) end, case when x.dd or x.cc then d.fired else list_append(d.fired, struct_pack(a := q.t0, z := q.t1)) end
  from d join q on q.key = d.key and q.i = d.i + 1, lateral (select {pad} as dd, {cooldown} as cc) x)"""


_BOTH = _fires("q.act - d.last < q.cd and q.cd > 0", "len(list_filter(d.fired, lambda f: greatest(q.t0 - f.z, f.a - q.t1) < 5000000)) > 0")


def _requests(spark, sf_dir) -> DataFrame:
    return funnel.funnel_requests(_stream(spark, sf_dir), tasks(spark, sf_dir), _O)


def _decided(spark, sf_dir) -> DataFrame:
    return funnel.brakes(_requests(spark, sf_dir), pad_s=_O.pad_s)


@query(_BOTH + " select key, t0, t1, id, not dedupe and not cooldown as fired, dedupe, cooldown, case when dedupe then 'dedupe' when cooldown then 'cooldown' end as brake from d")
def brakes_full(spark, sf_dir):
    return _decided(spark, sf_dir).select("key", "t0", "t1", "id", "fired", "dedupe", "cooldown", "brake")


@query(_BOTH + " select count(*) filter (not dedupe and not cooldown) as fired, count(*) filter (dedupe or cooldown) as suppressed, count(*) filter (dedupe) as suppressed_dedupe, count(*) filter (cooldown) as suppressed_cooldown from d")
def suppression_counts(spark, sf_dir):
    return funnel.suppression_counts(_decided(spark, sf_dir))


def _plain_requests(spark, sf_dir, cooldown_s: int) -> DataFrame:
    """One request per captioned window and camera, as the brakes' own input."""
    c = chunks(spark, sf_dir, where="not gated and camera_id is not null and t_end >= t_start")
    return c.select(F.col("camera_id").alias("key"), F.col("start_us").alias("t0"), F.col("end_us").alias("t1"), F.col("chunk_id").alias("id"), F.col("end_us").alias("act"), F.lit(cooldown_s * funnel.US).cast("long").alias("cooldown_us"))


_QC = f"""{_CH}, q as materialized (select camera_id as key, start_us as t0, end_us as t1, chunk_id as id, row_number() over (partition by camera_id order by start_us, chunk_id) as i from ch where not gated and camera_id is not null and start_us is not null and end_us >= start_us)"""


@query(f"with recursive {_QC}, d as (select key, i, id, true as f, t1 as last from q where i = 1 union all select q.key, q.i, q.id, q.t1 - d.last >= 300000000, case when q.t1 - d.last >= 300000000 then greatest(d.last, q.t1) else d.last end from d join q on q.key = d.key and q.i = d.i + 1) select key, id from d where f")
def cooldown_fires(spark, sf_dir):
    # A pad of 0 engages on real overlap only, so the ranges are made empty here to leave the cooldown alone.
    r = _plain_requests(spark, sf_dir, 300).withColumn("act", F.col("t1")).withColumn("t0", F.col("t0")).withColumn("t1", F.col("t0"))
    return funnel.brakes(r, pad_s=0).filter("fired").select("key", "id")


@query(f"with recursive {_QC}, d as (select key, i, id, true as f, t1 as hi from q where i = 1 union all select q.key, q.i, q.id, q.t0 - d.hi >= 5000000, case when q.t0 - d.hi >= 5000000 then greatest(d.hi, q.t1) else d.hi end from d join q on q.key = d.key and q.i = d.i + 1) select key, id from d where f")
def dedupe_fires(spark, sf_dir):
    return funnel.brakes(_plain_requests(spark, sf_dir, 0), pad_s=5).filter("fired").select("key", "id")


@query(f"with {_QC} select a.key, a.id, count(*) as n from q a join q b on a.key = b.key and greatest(a.t0 - b.t1, b.t0 - a.t1) < 5000000 and (b.t0 < a.t0 or (b.t0 = a.t0 and b.id < a.id)) group by 1, 2")
def dedupe_collisions_audit(spark, sf_dir):
    return funnel.collisions(_plain_requests(spark, sf_dir, 0), pad_s=5)


@query(f"with {_FU} select task_id, count(*) as n, count(*) filter (seen) as n_seen from pr group by 1")
def chunk_task_cross(spark, sf_dir):
    return _staged(spark, sf_dir).groupBy("task_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("seen").alias("n_seen"))


@query(f"""with recursive {_E}, lf as (select task_id, max(ts) as last_fired from e where parent_id is null and task_id is not null group by 1),
tk as (select lower(trim(task_id)) as task_id, enabled, cooldown, cast(active[1:2] as int) * 60 + cast(active[4:5] as int) as a, cast(active[7:8] as int) * 60 + cast(active[10:11] as int) as z,
  hour((make_timestamp({_NOW}) at time zone 'UTC') at time zone '{ZONE}') * 60 + minute((make_timestamp({_NOW}) at time zone 'UTC') at time zone '{ZONE}') as m from tasks)
select tk.task_id, case when not enabled then 'disabled' when not (case when a = z or (a = 0 and z = 1440) then true when a < z then m >= a and m < z else m >= a or m < z end) then 'out_of_window'
  when coalesce({_NOW} - last_fired < cooldown * 1000000, false) then 'cooling' else 'armed' end as state from tk left join lf on tk.task_id = lf.task_id""")
def card_state(spark, sf_dir):
    last = logs.last_fired(log(spark, sf_dir))
    t = tasks(spark, sf_dir).join(last, "task_id", "left").withColumn("now", F.timestamp_micros(F.lit(_NOW)))
    cooling = F.coalesce(F.lit(_NOW) - F.col("last_fired") < F.col("cooldown") * F.lit(funnel.US).cast("long"), F.lit(False))
    return t.select("task_id", funnel.card_state(F.col("enabled"), F.coalesce(tf.in_active_window("active", "now", ZONE), F.lit(False)), cooling, F.lit(False)).alias("state"))


@query(f"""with w as (select unnest([1, 2, 3]) as item, unnest(['a drum moved from the parcel shelf', 'cone burning', 'rope blocking wash bay today']) as text),
tk as (select task_id, list_filter(list_distinct({_TOK.format('describe_text')}), lambda x: not list_contains({tx.STOP_ITEMS}, x)) as want from tasks),
g as (select task_id, item, len(list_intersect(want, list_filter(list_distinct({_TOK.format('text')}), lambda x: not list_contains({tx.STOP_ITEMS}, x)))) / len(want) as o from tk, w)
select task_id, item, round(o, 6) as overlap from g where o >= 0.6 qualify row_number() over (partition by task_id order by o desc, item) = 1""")
def watch_item_match(spark, sf_dir):
    """The item of a short list that best covers each task's wording."""
    items = spark.createDataFrame([(1, "a drum moved from the parcel shelf"), (2, "cone burning"), (3, "rope blocking wash bay today")], "item int, text string")
    t = tasks(spark, sf_dir).select("task_id", tx.term_set("describe_text", tx.STOP_ITEMS).alias("want"))
    g = t.crossJoin(F.broadcast(items)).withColumn("o", tx.coverage(F.col("want"), tx.term_set("text", tx.STOP_ITEMS))).filter("o >= 0.6")
    best = g.groupBy("task_id").agg(F.max(F.struct("o", (-F.col("item")).alias("k"))).alias("m"))
    return best.select("task_id", (-F.col("m.k")).alias("item"), F.round("m.o", 6).alias("overlap"))


# --- Scheduling ---------------------------------------------------------------------------------


def _arrivals(spark, sf_dir) -> DataFrame:
    """Work for one queue per UTC hour: job requests, checks of alerts, captioned windows."""
    j = latest_jobs(spark, sf_dir).select("requested_us", "job_id")
    a = logs.entries(log(spark, sf_dir)).filter("parent_id is null")
    c = chunks(spark, sf_dir, where="not gated")
    part = lambda df, i, lane, t, s: df.select(F.col(i).alias("id"), F.lit(lane).alias("lane"), F.col(t).alias("arrived"), F.lit(s).cast("long").alias("service_us"))
    rows = part(j, "job_id", 0, "requested_us", 3 * funnel.US).unionByName(part(a, "entry_id", 1, "ts", 1 * funnel.US)).unionByName(part(c, "chunk_id", 2, "end_us", 2 * funnel.US))
    return rows.withColumn("queue", F.date_format(F.timestamp_micros("arrived"), "yyyyMMddHH"))


_ARR = f"""with recursive {_E}, {_J}, {_CH},
ar as (select job_id as id, 0 as lane, requested_us as arrived, 3000000 as service from lj union all select entry_id, 1, ts, 1000000 from e where parent_id is null union all select chunk_id, 2, end_us, 2000000 from ch where not gated),
q as materialized (select *, strftime(make_timestamp(arrived), '%Y%m%d%H') as queue, lane || '|' || id as k, case when lane = 2 then 5000000 end as cap from ar where arrived is not null),
d as (select queue, null::varchar as id, null::int as lane, null::bigint as arrived, null::bigint as started, false as overdue, 0::bigint as free, []::varchar[] as served from (select distinct queue from q)
  union all
  select queue, id, lane, arrived, begins, late, begins + service, list_append(served, k) from (
    select *, row_number() over (partition by queue order by not late, case when late then arrived else lane end, case when late then lane else arrived end, id) as n from (
      select *, coalesce(begins - arrived >= cap, false) as late from (
        select d.queue, q.id, q.lane, q.arrived, q.service, q.cap, q.k, d.served, greatest(d.free, min(q.arrived) over (partition by d.queue)) as begins from d join q on d.queue = q.queue and not list_contains(d.served, q.k)) where arrived <= begins)) where n = 1),
sc as (select queue, id, lane, arrived, started, (started - arrived) / 1e6 as wait_s, overdue from d where id is not null)"""


@query(_ARR + " select * from sc")
def priority_schedule(spark, sf_dir):
    return scheduling.replay(_arrivals(spark, sf_dir))


@query(_ARR + " select lane, count(*) as completed, max(wait_s) as max_wait_s, count(*) filter (overdue) as promotions from sc group by 1")
def queue_waits(spark, sf_dir):
    return scheduling.queue_stats(scheduling.replay(_arrivals(spark, sf_dir)))


@query(f"""with recursive {_J}, q as materialized (select concat_ws('-', start_us, end_us) as range_key, job_id, requested_us, coalesce(completed_us, 1::bigint << 62) as until, row_number() over (partition by concat_ws('-', start_us, end_us) order by requested_us, job_id) as i from lj where requested_us is not null),
d as (select range_key, i, job_id, null::varchar as attached_to, job_id as holder, until from q where i = 1
  union all select q.range_key, q.i, q.job_id, case when q.requested_us < d.until then d.holder end, case when q.requested_us < d.until then d.holder else q.job_id end, case when q.requested_us < d.until then d.until else q.until end from d join q on q.range_key = d.range_key and q.i = d.i + 1)
select job_id, range_key, attached_to from d""")
def in_flight_attached(spark, sf_dir):
    j = latest_jobs(spark, sf_dir).select(F.concat_ws("-", "start_us", "end_us").alias("range_key"), "job_id", "requested_us", "completed_us")
    return scheduling.in_flight_duplicates(j)


# --- Streams ------------------------------------------------------------------------------------


@query(f"with recursive {_QC}, d as (select key, i, id, true as f, t1 as hi from q where i = 1 union all select q.key, q.i, q.id, q.t0 - d.hi >= 5000000, case when q.t0 - d.hi >= 5000000 then greatest(d.hi, q.t1) else d.hi end from d join q on q.key = d.key and q.i = d.i + 1) select key, id, f as fired from d")
def stream_funnel(spark, sf_dir):
    """The brakes as a stream over the chunk files; equals the batch form."""
    folder = scratch_path(spark, "stream")
    _plain_requests(spark, sf_dir, 0).write.parquet(f"{folder}/in")
    src = spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).parquet(f"{folder}/in")
    live.run_available(live.stream_brakes(src, pad_s=5), folder)
    return spark.read.schema(live.DECISIONS).parquet(f"{folder}/out").select("key", "id", "fired")


@query(f"with {_CH} select chunk_id, start_us from ch where start_us is not null")
def stream_dedupe_late(spark, sf_dir):
    """The chunk tail: each id once, late rows kept aside and counted in."""
    folder = scratch_path(spark, "tail")
    raw = table(spark, sf_dir, "chunks").filter("t_start is not null").select("chunk_id", F.col("t_start").cast("timestamp").alias("t_start"), F.col("t_end").cast("timestamp").alias("t_end"))
    # Several files, each with rows of all times: with a batch per file, most rows of the later ones are late.
    raw.repartition(4, "chunk_id").write.parquet(f"{folder}/in")
    tail = live.chunk_tail(spark, f"{folder}/in", spark.read.parquet(f"{folder}/in").schema, files_per_batch=1, delay="30 days")
    live.run_available(tail, folder, sink=live.LateSink(folder, 600))
    rows = spark.read.parquet(f"{folder}/main").unionByName(spark.read.parquet(f"{folder}/late"))
    return rows.select("chunk_id", F.unix_micros("t_start").alias("start_us"))
