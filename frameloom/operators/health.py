"""Counts, rates, retention plans, confidence and other figures over the logs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

US = 1_000_000


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def index_counts(chunks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows, captioned and gated ones and the skip rate (AG1)."""
    gated = F.count_if(F.col("gated"))
    n = F.count(F.lit(1))
    return chunks.groupBy(*(by or [])).agg(n.alias("total"), F.count_if(~F.col("gated")).alias("captioned"), gated.alias("gated"), F.round(ratio(gated, F.count("gated")), 6).alias("skip_rate"))


def gate_health(counts: DataFrame, warn: float = 0.6) -> DataFrame:
    """empty, ok or low (AG2)."""
    return counts.withColumn("health", F.when(F.col("total") == 0, "empty").when(F.col("skip_rate") >= warn, "ok").otherwise("low"))


def run_stats(chunks: DataFrame) -> DataFrame:
    """Counters of an ingest run; the skip rate is over decided windows only (AG3).

    A window without a caption that is not gated could not be decoded.
    """
    captioned = F.count_if(~F.col("gated") & (F.coalesce("caption", F.lit("")) != ""))
    skipped = F.count_if(F.col("gated"))
    return chunks.agg(captioned.alias("captioned"), skipped.alias("skipped"), (F.count(F.lit(1)) - captioned - skipped).alias("undecided"), F.round(ratio(skipped, captioned + skipped), 6).alias("skip_rate"))


def freshness(chunks: DataFrame, now_us: int, by: str = "camera_id") -> DataFrame:
    """Seconds since the last window's end (ST13)."""
    return chunks.groupBy(by).agg(((F.lit(now_us) - F.max("end_us")) / 1e6).alias("age_s"))


def retention_age(older_than_s: float | None, *, default_s: float = 10_800, floor_s: float = 900) -> float:
    """The age to delete from; a non-finite one or one below the floor raises (F-V4)."""
    age = default_s if older_than_s is None else float(older_than_s)
    if not math.isfinite(age) or age < floor_s:
        raise ValueError(f"the age must be a number of at least {floor_s:g} seconds")
    return age


def retention_plan(segments: DataFrame, *, now_us: int, older_than_s: float | None = None, guard_s: float = 120) -> DataFrame:
    """Files that end at or before the cutoff, with ``doomed``: not the newest of their camera, not written lately (Q24).

    ``segments``: camera_id, path, start_us, eff_end, mtime_us, size_bytes.
    """
    cutoff = now_us - int(retention_age(older_than_s) * US)
    newest = F.row_number().over(Window.partitionBy("camera_id").orderBy(F.desc("start_us"), F.desc("path"))) == 1
    rows = segments.withColumn("newest", newest).filter(F.col("eff_end") <= cutoff)
    return rows.withColumn("doomed", ~F.col("newest") & (F.coalesce(F.col("mtime_us"), F.lit(0)) <= now_us - int(guard_s * US)))


def doomed_chunks(chunks: DataFrame, *, now_us: int, older_than_s: float | None = None) -> DataFrame:
    """Rows that ended by the cutoff."""
    return chunks.filter(F.col("end_us") <= now_us - int(retention_age(older_than_s) * US))


def retention_totals(plan: DataFrame) -> DataFrame:
    """Bytes and files to free and files kept (AG9)."""
    return plan.agg(F.coalesce(F.sum(F.when(F.col("doomed"), F.coalesce("size_bytes", F.lit(0)))), F.lit(0)).alias("bytes"), F.count_if("doomed").alias("files"), F.count_if(~F.col("doomed")).alias("kept"))


def retention_blockers(jobs: DataFrame, *, now_us: int, older_than_s: float | None = None) -> DataFrame:
    """Live jobs that read footage older than the cutoff (Q25)."""
    return jobs.filter(F.col("state").isin("queued", "running") & (F.col("start_us") < now_us - int(retention_age(older_than_s) * US)))


def confidence(requested: Column, covered: Column, decoded: Column, expected: Column, hedged: Column, factor: float = 0.35) -> Column:
    """Coverage times decode yield, less if hedged, within 0..1, to 4 digits (AG13)."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    value = unit(covered / requested) * F.when(expected <= 0, F.lit(0.0)).otherwise(unit(decoded / expected))
    return F.when(requested > 0, F.round(unit(F.when(hedged, value * factor).otherwise(value)), 4))


def expected_frames(duration_s: Column, fps: float) -> Column:
    """Frames of a decode: at least one, halves to even (F-M4)."""
    return F.greatest(F.lit(1), F.bround(duration_s * fps).cast("int"))


def verdict(state: Column, conf: Column, threshold: float = 0.5) -> Column:
    """verified, retracted, or null for a job that says nothing (ST7)."""
    return F.when((state == "done") & conf.isNotNull(), F.when(conf >= threshold, "verified").otherwise("retracted"))


def bench_figures(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Best, median and 95th percentile (AG20)."""
    return rows.groupBy(*by).agg(F.min(value).alias("best"), F.percentile(value, F.lit(0.5)).alias("median"), F.percentile(value, F.lit(0.95)).alias("p95"), F.count(value).alias("n"))


def newest(rows: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The newest n rows, oldest first."""
    return rows.orderBy(*[F.desc(c) for c in order]).limit(n).orderBy(*order)


def next_free_name(names: DataFrame, name: str = "camera_id", prefix: str = "clip") -> DataFrame:
    """The lowest unused number of ``<prefix>NN`` names (AG23): a used number whose successor, or 1, is unused."""
    used = names.select(F.regexp_extract(F.col(name), f"^{prefix}(\\d+)$", 1).alias("d")).filter("d <> ''").select(F.col("d").cast("long").alias("k")).distinct()
    zero = names.sparkSession.range(1).select(F.lit(0).cast("long").alias("k"))
    nxt = zero.unionByName(used).select((F.col("k") + 1).alias("k"))
    return nxt.join(used, "k", "left_anti").agg(F.min("k").alias("k")).select(F.format_string(f"{prefix}%02d", "k").alias("name"))
