"""Interval algebra: planned windows, effective segment ends, range tiling with gaps, instants in segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

US = 1_000_000


def plan_windows(spans: DataFrame, window_s: float, stride_s: float, *, start_index: int = 0, start: str = "start_us", end: str = "end_us") -> DataFrame:
    """Complete windows of each span, anchored at its start: ``index, w_start, w_end`` (Q13).

    A span shorter than the window has none.
    """
    if window_s <= 0 or stride_s <= 0:
        raise ValueError("window_s and stride_s must be positive")
    w, s = int(window_s * US), int(stride_s * US)
    n = F.floor((F.col(end) - F.col(start) - w) / F.lit(s)).cast("long") + 1
    rows = spans.filter(F.col(end) - F.col(start) >= w).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    return rows.withColumn("index", F.col("_i") + start_index).withColumn("w_start", F.col(start) + F.col("_i") * s).withColumn("w_end", F.col("w_start") + w).drop("_i")


def hop_counts(events: DataFrame, ts: Column, window: str, stride: str, start_time: str = "0 seconds") -> DataFrame:
    """Events per hopping window (ST1)."""
    return events.groupBy(F.window(ts, window, stride, start_time).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.unix_micros("w.start").alias("w_start"), "n")


def effective_ends(segments: DataFrame, *, key: str = "camera_id", start: str = "start_us", nominal_s: float = 60, drift_s: float = 2) -> DataFrame:
    """Adds ``eff_end`` and ``nominal``: a file lasts until the next one starts, if that is at most the drift after its nominal end."""
    nxt = F.lead(start).over(Window.partitionBy(key).orderBy(start))
    nominal_end = F.col(start) + int(nominal_s * US)
    joined = nxt.isNotNull() & (nxt <= nominal_end + int(drift_s * US))
    return segments.withColumn("eff_end", F.when(joined, nxt).otherwise(nominal_end)).withColumn("nominal", ~joined)


def tile_ranges(requests: DataFrame, segments: DataFrame, *, bucket_s: float = 600) -> DataFrame:
    """Tile each request exactly with segment spans and gaps.

    ``requests``: req, camera_id, t0, t1; ``segments``: camera_id, path, start_us,
    eff_end, not overlapping within a camera. Rows: req, camera_id, path (null:
    gap), span_start, span_end, pts_in, pts_out, is_gap. The overlap join meets
    on (camera, time bucket), so it is an equi-join at every size.
    """
    b = int(bucket_s * US)
    bucket = lambda c: F.floor(c / F.lit(b)).cast("long")
    req = requests.filter(F.col("t1") > F.col("t0"))
    r = req.withColumn("bkt", F.explode(F.sequence(bucket(F.col("t0")), bucket(F.col("t1")))))
    s = segments.filter(F.col("eff_end") > F.col("start_us")).withColumn("bkt", F.explode(F.sequence(bucket(F.col("start_us")), bucket(F.col("eff_end")))))
    # A pair that meets in several buckets is kept in the first one only.
    hit = r.join(s, ["camera_id", "bkt"]).filter((F.col("start_us") < F.col("t1")) & (F.col("eff_end") > F.col("t0")) & (F.col("bkt") == F.greatest(bucket(F.col("t0")), bucket(F.col("start_us")))))
    spans = hit.select("req", "camera_id", "t0", "t1", "path", "start_us", F.greatest("t0", "start_us").alias("a"), F.least("t1", "eff_end").alias("z"))
    # A span starts where the ones before it ended, as a cursor would have it.
    w = Window.partitionBy("req").orderBy("start_us", "path")
    cursor = F.coalesce(F.max("z").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("t0"))
    walked = spans.withColumn("cur", cursor).filter(F.col("z") > F.col("cur")).withColumn("a", F.greatest("a", "cur"))
    gap = lambda a, z: F.struct(F.lit(None).cast("string").alias("path"), F.lit(None).cast("long").alias("seg"), a.alias("a"), z.alias("z"))
    body = walked.select("req", "camera_id", F.explode(F.array(F.struct("path", F.col("start_us").alias("seg"), "a", "z"), gap(F.col("cur"), F.col("a")))).alias("x"))
    ends = req.join(walked.groupBy("req").agg(F.max("z").alias("last")), "req", "left")
    tail = ends.select("req", "camera_id", gap(F.coalesce("last", "t0"), F.col("t1")).alias("x"))
    return (
        body.unionByName(tail)
        .select("req", "camera_id", "x.*")
        .filter(F.col("a") < F.col("z"))
        .select("req", "camera_id", "path", F.col("a").alias("span_start"), F.col("z").alias("span_end"), ((F.col("a") - F.col("seg")) / 1e6).alias("pts_in"), ((F.col("z") - F.col("seg")) / 1e6).alias("pts_out"), F.col("path").isNull().alias("is_gap"))
    )


def covered_seconds(spans: DataFrame) -> DataFrame:
    """Covered and missing seconds per request (AG8)."""
    d = (F.col("span_end") - F.col("span_start")) / 1e6
    return spans.groupBy("req").agg(F.round(F.sum(F.when(~F.col("is_gap"), d).otherwise(0.0)), 6).alias("covered_s"), F.round(F.sum(F.when(F.col("is_gap"), d).otherwise(0.0)), 6).alias("gap_s"))


def require_complete(spans: DataFrame) -> DataFrame:
    """The spans; reading the path of a gap is an error (Q12)."""
    return spans.withColumn("path", F.when(F.col("is_gap"), F.raise_error(F.lit("footage is missing")).cast("string")).otherwise(F.col("path")))


def segment_of_instant(instants: DataFrame, segments: DataFrame, *, bucket_s: float = 600) -> DataFrame:
    """The segment that covers each instant, half-open, and the seconds into it; null if none does.

    ``instants``: key, camera_id, t; of several covering segments the one that
    starts last, then the greatest path.
    """
    b = int(bucket_s * US)
    bucket = lambda c: F.floor(c / F.lit(b)).cast("long")
    s = segments.filter(F.col("eff_end") > F.col("start_us")).withColumn("bkt", F.explode(F.sequence(bucket(F.col("start_us")), bucket(F.col("eff_end") - 1)))).select("camera_id", "bkt", "path", "start_us", "eff_end")
    i = instants.withColumn("bkt", bucket(F.col("t")))
    hit = i.join(s, ["camera_id", "bkt"]).filter((F.col("start_us") <= F.col("t")) & (F.col("t") < F.col("eff_end")))
    best = hit.groupBy("key").agg(F.max(F.struct("start_us", "path")).alias("m"))
    return instants.join(best, "key", "left").select("key", "camera_id", "t", "m.path", ((F.col("t") - F.col("m.start_us")) / 1e6).alias("pts_offset"))


def clip_plan(spans: DataFrame) -> DataFrame:
    """Cuts of an evidence clip per request: path, seek and duration in order; one cut is a plain copy, more are joined (SK12)."""
    cut = F.struct(F.col("span_start").alias("at"), "path", F.col("pts_in").alias("seek_s"), (F.col("pts_out") - F.col("pts_in")).alias("duration_s"))
    plan = spans.filter(~F.col("is_gap")).groupBy("req").agg(F.array_sort(F.collect_list(cut)).alias("cuts"))
    return plan.select("req", F.size("cuts").alias("n_cuts"), (F.size("cuts") > 1).alias("joined"), "cuts")


def strip(chunks: DataFrame, t_from, t_to) -> DataFrame:
    """Segments of a strip of chunks, open overlap, in order of first use (J4, AG14)."""
    rows = chunks.filter((F.col("t_end") > F.lit(t_from)) & (F.col("t_start") < F.lit(t_to)) & (F.coalesce("segment", F.lit("")) != ""))
    return rows.groupBy("camera_id", "segment").agg(F.min("t_start").alias("first_start"), F.count(F.lit(1)).alias("n"))


def archive_bounds(segments: DataFrame, *, exclude_open: bool = True, key: str = "camera_id") -> DataFrame:
    """First start and last end per camera; the newest file may be still open; fewer than two files give none (SC8)."""
    last = Window.partitionBy(key)
    rows = segments.withColumn("_n", F.count(F.lit(1)).over(last)).withColumn("_newest", F.max("start_us").over(last))
    if exclude_open:
        rows = rows.filter((F.col("_n") >= 2) & (F.col("start_us") < F.col("_newest")))
    return rows.groupBy(key).agg(F.min("start_us").alias("start_us"), F.max("eff_end").alias("end_us"))
