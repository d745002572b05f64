"""The test tables as the operators want them: keys canonical, times in microseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.functions.keys import canon_file, canon_id, micros


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def coverage_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, camera_id, start_us, end_us) of chunks and segments."""
    one = lambda src, a, z: table(spark, sf_dir, src).select(F.lit(src).alias("src"), canon_id("camera_id").alias("camera_id"), micros(a).alias("start_us"), micros(z).alias("end_us"))
    return one("chunks", "t_start", "t_end").unionByName(one("segments", "seg_start", "seg_end"))


def activity_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, t, id) of the captioned windows."""
    return table(spark, sf_dir, "chunks").filter(~F.col("gated")).select(canon_id("camera_id").alias("key"), micros("t_start").alias("t"), F.col("chunk_id").alias("id"))


def action_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "actions").select("entry_id", micros("ts").alias("ts"), "parent_id", "status")


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, field, rec_id, key, ts): each chunk and each entry once, an entry at its earliest ts."""
    chunks = table(spark, sf_dir, "chunks").select(F.lit("chunks").alias("src"), F.lit("segment").alias("field"), F.col("chunk_id").alias("rec_id"), canon_file("segment").alias("key"), micros("t_start").alias("ts"))
    chunks = chunks.filter("key <> ''").groupBy("src", "field", "rec_id").agg(F.min("key").alias("key"), F.min("ts").alias("ts"))
    late = F.lit(2**62)
    first = (
        table(spark, sf_dir, "actions")
        .select("entry_id", F.struct(F.coalesce(micros("ts"), late).alias("ts"), canon_id("task_id").alias("task_id"), canon_id("job_id").alias("job_id"), canon_file("clip_path").alias("clip_path")).alias("r"))
        .groupBy("entry_id")
        .agg(F.min("r").alias("r"))
    )
    fields = ["task_id", "job_id", "clip_path"]
    actions = first.select(
        F.lit("actions").alias("src"), F.col("entry_id").alias("rec_id"), F.when(F.col("r.ts") < late, F.col("r.ts")).alias("ts"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"r.{f}").alias("key")) for f in fields])).alias("x")
    ).select("src", "x.field", "rec_id", "x.key", "ts")
    return chunks.unionByName(actions)


def reference_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, key, present, removed, gone_at, since) of everything that may be named."""

    def facts(name: str, field: str, key, *, present=False, removed=False, gone_at=None, since=None) -> DataFrame:
        us = lambda c: micros(c) if c else F.lit(None).cast("long")
        return table(spark, sf_dir, name).select(F.lit(field).alias("field"), key.alias("key"), F.lit(present).alias("present"), F.lit(removed).alias("removed"), us(gone_at).alias("gone_at"), us(since).alias("since"))

    parts = [
        facts("segments", "segment", canon_file("path"), present=True),
        facts("removed_files", "segment", canon_file("path"), removed=True),
        facts("tasks", "task_id", canon_id("task_id"), present=True),
        facts("retired_tasks", "task_id", canon_id("task_id"), gone_at="retired_at"),
        facts("jobs", "job_id", canon_id("job_id"), present=True, since="requested_at"),
        facts("clips", "clip_path", canon_file("path"), present=True, since="mtime"),
        facts("removed_files", "clip_path", canon_file("path"), removed=True),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
