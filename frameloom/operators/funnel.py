"""Standing queries over the chunk stream: match, confirm, sustain, brakes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.functions.text import STOP_CONFIRM, coverage, item_verdict, term_set, watch_block, watch_items
from frameloom.functions.timefmt import active_minutes, local_minute, minute_in
from frameloom.functions.vector import dot, norm
from frameloom.session import discard, materialize

US = 1_000_000


@dataclass(frozen=True)
class FunnelOptions:
    """Thresholds of the stages, the pad of the dedupe brake, the zone of active hours, and the limit of tasks sent to every executor."""

    stage1: float = 0.15
    stage2: float = 0.5
    pad_s: float = 5.0
    zone: str = "America/Los_Angeles"
    max_tasks: int = 10_000
    bucket_s: float = 3600.0


def pair_with_tasks(chunks: DataFrame, tasks: DataFrame, o: FunnelOptions) -> DataFrame:
    """Every chunk against every standing query.

    The tasks are a stated query set; their number is checked before they are
    broadcast. What depends on one side only (norms, words, the local minute,
    the watch list) is worked out before the two meet.
    """
    n = tasks.limit(o.max_tasks + 1).count()
    if n > o.max_tasks:
        raise ValueError(f"more than {o.max_tasks} tasks; evaluate them in blocks")
    w = active_minutes("active")
    parsed = tasks.withColumn("active_from", w["start"]).withColumn("active_to", w["end"]).withColumn("_wanted", term_set("describe_text", STOP_CONFIRM)).withColumn("_task_norm", norm("task_embedding"))
    caption = F.coalesce("caption", F.lit(""))
    seen = ~F.coalesce("gated", F.lit(True)) & (caption != "")
    told = chunks.withColumn("seen", seen).withColumn("_minute", local_minute("t_start", o.zone))
    told = told.withColumn("_norm", F.when(F.col("seen"), norm("embedding"))).withColumn("_terms", F.when(F.col("seen"), term_set(caption, STOP_CONFIRM))).withColumn("_watching", F.when(F.col("seen") & F.lower(caption).contains("watching"), watch_items(watch_block(caption))))
    return told.crossJoin(F.broadcast(parsed))


def stage_columns(pairs: DataFrame, o: FunnelOptions, *, watchlists: bool = False) -> DataFrame:
    """Adds awake, stage1_score, stage1 and ``ok`` to the pairs of :func:`pair_with_tasks` and drops vectors and word lists (ST3).

    A stated watch-list verdict outranks the cosine; null is no verdict. A row
    without a caption counts as gated. Only pairs that are awake and seen are
    scored.
    """
    awake = F.coalesce("enabled", F.lit(False)) & F.coalesce(minute_in(F.col("active_from"), F.col("active_to"), F.col("_minute")), F.lit(False))
    like = (F.col("_norm") > 0) & (F.col("_task_norm") > 0) & (F.size("embedding") == F.size("task_embedding")) & (F.size("embedding") > 0)
    score = F.coalesce(F.round(F.when(like, dot("task_embedding", "embedding") / (F.col("_task_norm") * F.col("_norm"))).otherwise(0.0), 9), F.lit(0.0))
    stage1 = F.col("stage1_score") >= o.stage1
    if watchlists:
        stated = item_verdict(F.col("_watching"), "describe_text")
        score = F.when(stated.isNotNull(), stated.cast("double")).otherwise(score)
        stage1 = F.coalesce(stated, stage1)
    out = pairs.withColumn("awake", awake).withColumn("stage1_score", F.when(F.col("awake") & F.col("seen"), score)).withColumn("stage1", F.coalesce(F.col("awake") & F.col("seen") & stage1, F.lit(False)))
    out = out.withColumn("ok", F.when(F.col("stage1"), coverage(F.col("_wanted"), F.col("_terms")) >= o.stage2).otherwise(False))
    return out.drop("embedding", "task_embedding", "_wanted", "_terms", "_watching", "_minute", "_norm", "_task_norm")


def _bucket(o: FunnelOptions) -> Column:
    return F.floor(F.unix_seconds(F.col("t_start").cast("timestamp")) / F.lit(o.bucket_s)).cast("long")


def _running(rows: DataFrame, keys: list[str], n: Column, name: str, o: FunnelOptions) -> DataFrame:
    """Adds the running sum of ``n`` in order of (t_start, chunk_id), per key if keys are given: a prefix sum over time buckets and one inside each, so that no key is one task."""
    rows = rows.withColumn("_b", _bucket(o))
    before = rows.groupBy(*keys, "_b").agg(F.sum(n).alias("_n"))
    so_far = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select(*keys, "_b", F.coalesce(F.sum("_n").over(so_far), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_b").orderBy("t_start", "chunk_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_in", F.sum(n).over(inside)).join(before, [*keys, "_b"]).withColumn(name, F.col("_before") + F.col("_in")).drop("_b", "_before", "_in")


def sustained(rows: DataFrame, o: FunnelOptions, *, key: str = "task_id", stream: DataFrame | None = None) -> DataFrame:
    """Adds run, run_since, held_s, promoted and ``requests`` to the rows that are ok.

    A run is broken by any row of the key that is not ok, not by a hole in
    time. Rows are in order of (t_start, chunk_id); a run's number is the count
    of breaks before it. Where every key meets every row of one ``stream``
    (chunk_id once each, t_start), the breaks before a row are the rows of the
    stream up to it less the key's ok rows up to it, so of the pairs only those
    that are ok move; without it, the breaks of each key are counted.
    """
    one = F.lit(1).cast("long")
    if stream is None:
        hits = materialize(_running(rows.withColumn("ok", F.coalesce("ok", F.lit(False))), [key], (~F.col("ok")).cast("long"), "run", o).filter("ok"), "runs")
    else:
        ok = materialize(rows.filter("ok"), "hits")
        places = _running(stream.select("chunk_id", "t_start"), [], one, "_at", o).select("chunk_id", "_at")
        hits = materialize(_running(ok, [key], one, "_nth", o).join(places, "chunk_id").withColumn("run", F.col("_at") - F.col("_nth")).drop("_at", "_nth"), "runs")
        discard(ok)
    since = hits.groupBy(key, "run").agg(F.min("t_start").alias("run_since"))
    held = (F.unix_micros(F.col("t_end").cast("timestamp")) - F.unix_micros(F.col("run_since").cast("timestamp"))) / F.lit(1e6)
    out = hits.join(since, [key, "run"]).withColumn("held_s", held).withColumn("requests", F.col("held_s") >= F.col("window_s"))
    first = out.filter("requests").groupBy(key, "run").agg(F.min(F.struct("t_start", "chunk_id")).alias("_f"))
    return out.join(first, [key, "run"], "left").withColumn("promoted", F.coalesce((F.col("_f.t_start") == F.col("t_start")) & (F.col("_f.chunk_id") == F.col("chunk_id")), F.lit(False))).drop("_f")


class BrakeState:
    """What one key must remember: the latest act, and fired ranges that may still collide."""

    __slots__ = ("last", "ranges")

    def __init__(self, last: int | None = None, ranges: list | None = None) -> None:
        self.last, self.ranges = last, ranges or []

    def decide(self, act: int, t0: int, t1: int, cooldown_us: int, pad_us: int) -> tuple[bool, bool]:
        """(dedupe, cooldown) for a request; fires, and remembers it, if neither holds."""
        dedupe = any(max(t0 - z, a - t1) < pad_us for a, z in self.ranges)
        cooldown = cooldown_us > 0 and self.last is not None and act - self.last < cooldown_us
        if not dedupe and not cooldown:
            self.last = act if self.last is None else max(self.last, act)
            self.ranges.append((t0, t1))
        return dedupe, cooldown

    def forget_before(self, t0: int, pad_us: int) -> None:
        """Drop ranges that no later request in order of start can meet."""
        self.ranges = [r for r in self.ranges if t0 - r[1] < pad_us]


BRAKES = "key string, t0 bigint, t1 bigint, id string, act bigint, fired boolean, dedupe boolean, cooldown boolean, brake string"


def _brake_batches(pad_us: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, state = object(), BrakeState()
        for b in batches:
            if not b.num_rows:
                continue
            ded, cool = [], []
            for k, n, t0, t1, act, cd in zip(*(b.column(c).to_pylist() for c in ("key", "_stretch", "t0", "t1", "act", "cooldown_us"))):
                if (k, n) != place:
                    place, state = (k, n), BrakeState()
                state.forget_before(t0, pad_us)
                d, c = state.decide(act, t0, t1, cd, pad_us)
                ded.append(d)
                cool.append(c)
            d, c = np.array(ded), np.array(cool)
            name = np.where(d, "dedupe", np.where(c, "cooldown", None))
            yield pa.RecordBatch.from_arrays([*[b.column(x) for x in ("key", "t0", "t1", "id", "act")], pa.array(~d & ~c), pa.array(d), pa.array(c), pa.array(name, pa.string())], names=[x.split()[0] for x in BRAKES.split(", ")])

    return run


def stretches(requests: DataFrame, pad_us: int, bucket_us: int = 3600 * US) -> DataFrame:
    """Adds ``_stretch``: numbers of parts of a key's requests that cannot touch each other.

    A new stretch begins where no later request lies within the pad of an
    earlier range, or acts within the key's longest cooldown of an earlier act,
    so that whatever fired before is without effect. Running maxima, minima
    and counts are taken per (key, time bucket) and carried over by one row per
    bucket, so that no key is one task.
    """
    r = requests.withColumn("_k", F.struct(F.col("key").isNull().alias("none"), F.coalesce("key", F.lit("")).alias("key"))).withColumn("_b", F.floor(F.col("t0") / F.lit(bucket_us)).cast("long"))
    group = ["_k", "_b"]
    key = Window.partitionBy("_k").orderBy("_b")
    before, after = key.rowsBetween(Window.unboundedPreceding, -1), key.rowsBetween(1, Window.unboundedFollowing)
    per = r.groupBy(*group).agg(F.max("t1").alias("_z"), F.max("act").alias("_a"), F.min("act").alias("_m"), F.max("cooldown_us").alias("_cd"))
    per = per.select(*group, F.max("_z").over(before).alias("_pz"), F.max("_a").over(before).alias("_pa"), F.min("_m").over(after).alias("_nm"), F.max("_cd").over(Window.partitionBy("_k")).alias("_most"))
    order = Window.partitionBy(*group).orderBy("t0", "id")
    sofar, ahead = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    r = r.join(per, group)
    last_end, last_act = F.greatest("_pz", F.max("t1").over(sofar)), F.greatest("_pa", F.max("act").over(sofar))
    free = (F.col("t0") - last_end >= pad_us) & (F.least("_nm", F.min("act").over(ahead)) - last_act >= F.greatest("_most", F.lit(0)))
    r = r.withColumn("_new", F.coalesce(free, F.lit(True)).cast("long")).drop("_pz", "_pa", "_nm", "_most")
    count = r.groupBy(*group).agg(F.sum("_new").alias("_n")).select(*group, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return r.withColumn("_in", inside).join(count, group).withColumn("_stretch", F.col("_before") + F.col("_in")).drop("_k", "_b", "_new", "_in", "_before")


def brakes(requests: DataFrame, *, pad_s: float = 5.0) -> DataFrame:
    """Decide every request of ``(key, t0, t1, id, act, cooldown_us)`` in order of (t0, id) (ST4, Q28).

    Both brakes are always evaluated; dedupe is the one that is named. Only
    fired requests count as prior. A null key is a key like any other, a null
    cooldown is none, and rows with another null take no part. The
    decisions within one of a key's :func:`stretches` depend on each other, so
    a stretch is one stream; its rows pass through in batches and its state is
    a few ranges. A key that never pauses is one stretch.
    """
    if pad_s < 0:
        raise ValueError("pad_s must not be negative")
    pad = int(pad_s * US)
    whole = requests.select("key", "t0", "t1", "id", "act", F.coalesce("cooldown_us", F.lit(0)).cast("long").alias("cooldown_us")).filter("t0 is not null and t1 is not null and id is not null and act is not null")
    rows = stretches(whole, pad)
    return rows.repartition("key", "_stretch").sortWithinPartitions("key", "_stretch", "t0", "id").mapInArrow(_brake_batches(pad), BRAKES)


def funnel_requests(chunks: DataFrame, tasks: DataFrame, o: FunnelOptions | None = None, *, watchlists: bool = False) -> DataFrame:
    """Requests of all standing queries, with the act at the end of the requesting chunk (no wall clock in replay)."""
    o = o or FunnelOptions()
    rows = sustained(stage_columns(pair_with_tasks(chunks, tasks, o), o, watchlists=watchlists), o, stream=chunks).filter("requests")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return rows.select(F.concat_ws("|", "task_id", "action").alias("key"), us("run_since").alias("t0"), us("t_end").alias("t1"), F.concat_ws("|", "chunk_id", "task_id").alias("id"), us("t_end").alias("act"), (F.col("cooldown") * US).cast("long").alias("cooldown_us"))


def suppression_counts(decided: DataFrame) -> DataFrame:
    """Fired, suppressed, and per brake; a row may engage both (AG19)."""
    return decided.agg(F.count_if("fired").alias("fired"), F.count_if(~F.col("fired")).alias("suppressed"), F.count_if("dedupe").alias("suppressed_dedupe"), F.count_if("cooldown").alias("suppressed_cooldown"))


def counters(rows: DataFrame) -> DataFrame:
    """Funnel counters per task (AG18)."""
    return rows.groupBy("task_id").agg(F.count(F.lit(1)).alias("pairs"), F.count_if("awake").alias("awake"), F.count_if("stage1").alias("stage1"), F.count_if("ok").alias("stage2"))


def cooldown_left(now_us: Column, last_fired: Column, cooldown_s: Column) -> Column:
    """Seconds until a task may act again; 0 if it never did (F-D6)."""
    return F.coalesce(F.greatest(F.lit(0.0), cooldown_s - (now_us - last_fired) / US), F.lit(0.0))


def sustained_share(run_since: Column, until: Column, window_s: Column) -> Column:
    """How far a run has come towards its window, within 0..1; a window of 0 is full at once (F-D6)."""
    held = F.greatest(F.lit(0.0), (until - run_since) / US)
    return F.when(run_since.isNull(), F.lit(0.0)).when(window_s <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), held / window_s))


def card_state(enabled: Column, in_window: Column, cooling: Column, matching: Column) -> Column:
    """disabled > out_of_window > cooling > matching > armed (Q27)."""
    return F.when(~enabled, "disabled").when(~in_window, "out_of_window").when(cooling, "cooling").when(matching, "matching").otherwise("armed")


def collisions(ranges: DataFrame, *, pad_s: float = 5.0, bucket_s: float = 600.0) -> DataFrame:
    """Per range, how many earlier-starting ranges of its key lie within the pad (J12), met on time buckets.

    ``ranges``: key, id, t0, t1. Ranges of equal start are ordered by id.
    """
    b, pad = int(bucket_s * US), int(pad_s * US)
    bucket = lambda c: F.floor(c / F.lit(b)).cast("long")
    r = ranges.select("key", "id", "t0", "t1").filter(F.col("t1") >= F.col("t0"))
    left = r.withColumn("bkt", F.explode(F.sequence(bucket(F.col("t0") - pad), bucket(F.col("t1") + pad))))
    right = r.select(F.col("key"), F.col("id").alias("id2"), F.col("t0").alias("u0"), F.col("t1").alias("u1")).withColumn("bkt", F.explode(F.sequence(bucket(F.col("u0")), bucket(F.col("u1")))))
    meet = left.join(right, ["key", "bkt"]).filter((F.greatest(F.col("t0") - F.col("u1"), F.col("u0") - F.col("t1")) < pad) & (F.struct("u0", "id2") < F.struct("t0", "id")) & (F.col("bkt") == F.greatest(bucket(F.col("t0") - pad), bucket(F.col("u0")))))
    return meet.groupBy("key", "id").agg(F.count(F.lit(1)).alias("n"))
