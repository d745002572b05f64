"""Append-only logs: one row per action, last-row-wins views, range reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.operators.changefeed import distinct_entries, resolve_roots

#: Fixed value: the actions that reach a human are all but this one.
SILENT_ACTION = "save_clip"


def entries(log: DataFrame) -> DataFrame:
    """Each entry once, at its earliest ts (in microseconds), with all its columns."""
    rest = [c for c in log.columns if c not in ("entry_id", "ts")]
    return log.groupBy("entry_id").agg(F.min_by(F.struct("ts", *rest), F.struct("ts", *[F.col(c) for c in rest])).alias("r")).select("entry_id", "r.*")


def with_roots(log: DataFrame) -> DataFrame:
    """Entries with the ``root`` that their parents lead to; entries that lead to none stand for themselves."""
    once = entries(log)
    led = resolve_roots(distinct_entries(once.select("entry_id", "ts", "parent_id", "status"))).select("entry_id", "root")
    return once.join(led, "entry_id", "left").withColumn("root", F.coalesce("root", "entry_id"))


def fold(log: DataFrame) -> DataFrame:
    """One row per action: the latest status, and the last clip, job and reason that any of its entries has (AG4, AG5).

    Entries of an action are ordered by (ts, entry_id). The fold is a partial
    aggregate, so an action with very many amendments costs no more.
    """
    e = with_roots(log).withColumn("o", F.struct("ts", "entry_id"))
    some = lambda c: F.max(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct("o", c)))
    own = F.col("entry_id") == F.col("root")
    out = e.groupBy("root").agg(
        F.max(F.when(own, F.col("action"))).alias("action"),
        F.max(F.when(own, F.col("task_id"))).alias("task_id"),
        F.max(F.when(own, F.col("ts"))).alias("acted_at"),
        F.max(F.struct("o", "status")).alias("l"),
        some("clip_path").alias("c"),
        some("job_id").alias("j"),
        some("reason").alias("r"),
        (F.count(F.lit(1)) - 1).alias("n_amendments"),
    )
    return out.select("root", "action", "task_id", "acted_at", "n_amendments", F.col("l.status").alias("status"), F.col("l.o.ts").alias("resolved_at"), F.col("c.clip_path").alias("clip_path"), F.col("j.job_id").alias("job_id"), F.coalesce("r.reason", F.lit("")).alias("reason"))


def pending_verification(folded: DataFrame) -> DataFrame:
    """Actions that reach a human and have not been judged."""
    return folded.filter((F.col("action") != SILENT_ACTION) & (F.col("status") == "unverified"))


def range_read(log: DataFrame, t_from: int, t_to: int) -> DataFrame:
    """Entries acted in the range (closed) or about footage in it (open), with all entries of their actions (Q8, SO3)."""
    e = with_roots(log)
    hit = ((F.col("ts") >= t_from) & (F.col("ts") <= t_to)) | ((F.col("t_start") < t_to) & (F.col("t_end") > t_from))
    return e.join(e.filter(hit).select("root").distinct(), "root", "left_semi")


def timeline(log: DataFrame, zone: str) -> DataFrame:
    """Per local day of a root: actions and retracted ones, folded by the immediate parent (J6, AG21)."""
    e = entries(log)
    ids = e.select(F.col("entry_id").alias("pid"))
    known = e.join(ids, e["parent_id"] == ids["pid"], "left")
    kids = known.filter("pid is not null").groupBy(F.col("pid").alias("entry_id")).agg(F.max(F.struct("ts", F.col("entry_id").alias("i"), "status")).alias("k"))
    roots = known.filter("pid is null").select("entry_id", "ts", "status").join(kids, "entry_id", "left").withColumn("final", F.coalesce("k.status", "status"))
    day = F.date_format(F.from_utc_timestamp(F.timestamp_micros("ts"), zone), "yyyy-MM-dd")
    return roots.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n_actions"), F.count_if(F.col("final") == "retracted").alias("n_retracted"))


def latest_by(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key (AG6)."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


#: Fixed value: how far a job's state has come.
JOB_ORDER = {"queued": 0, "running": 1, "done": 2, "timeout": 3, "failed": 4}


def job_rank(state: Column) -> Column:
    out = F.lit(-1)
    for s, r in JOB_ORDER.items():
        out = F.when(state == s, r).otherwise(out)
    return out


def unfinished(latest_jobs: DataFrame) -> DataFrame:
    """Jobs whose last state is queued or running."""
    return latest_jobs.filter(F.col("state").isin("queued", "running"))


def reconcile(latest_jobs: DataFrame, now_us: int) -> DataFrame:
    """The failed rows that a restart appends for unfinished jobs (ST12)."""
    return unfinished(latest_jobs).select("job_id", F.lit("failed").alias("state"), F.lit(now_us).cast("long").alias("completed_us"), F.lit("restarted while unfinished").alias("error"))


def last_fired(log: DataFrame) -> DataFrame:
    """When each task last fired, by its original entries (AG7)."""
    return entries(log).filter("parent_id is null and task_id is not null").groupBy("task_id").agg(F.max("ts").alias("last_fired"))


def overlay(live: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Stored rows replaced by live ones of the same key."""
    cols = [c for c in stored.columns if c != key]
    a, b = live.alias("a"), stored.alias("b")
    return a.join(b, key, "full_outer").select(key, *[F.when(F.col(f"a.{cols[0]}").isNotNull(), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in cols])


def seed_with(seed: DataFrame, registered: DataFrame, removed: DataFrame, key: str = "task_id") -> DataFrame:
    """Seed rows overlaid by registrations, without removed keys."""
    kept = seed.join(registered.select(key), key, "left_anti").unionByName(registered)
    return kept.join(removed.select(key), key, "left_anti")


def amend(log: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows to append for ``(parent_id, entry_id, ts, status, reason)``; action, task and range come from the parent (Q29).

    The state ``unverified`` is no amendment and an unknown parent has no row:
    both are left out; :func:`rejected_amendments` lists them.
    """
    base = entries(log).select(F.col("entry_id").alias("parent_id"), "action", "task_id", "t_start", "t_end")
    return changes.filter(F.col("status").isin("verified", "retracted")).join(base, "parent_id")


def rejected_amendments(log: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes that :func:`amend` leaves out, and why."""
    known = log.select(F.col("entry_id").alias("parent_id")).distinct().withColumn("known", F.lit(True))
    why = F.when(~F.col("status").isin("verified", "retracted"), "no amending status").when(F.col("known").isNull(), "unknown entry")
    return changes.join(known, "parent_id", "left").withColumn("why", why).filter("why is not null").drop("known")
