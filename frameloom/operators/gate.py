"""The motion gate over small grey frames, as arrays of pixel values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split_frames(raw: Column, pixels: int) -> Column:
    """A raw grey stream as frames of ``pixels`` bytes; a partial tail is dropped (SC18)."""
    n = F.floor(F.octet_length(raw) / pixels).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(raw, i * pixels + 1, F.lit(pixels)))).otherwise(F.array().cast("array<binary>"))


def active_mask(frames: Column) -> Column:
    """Per pixel, the range of its values over the frames (AG12)."""
    low = F.aggregate(F.slice(frames, 2, F.size(frames)), frames[0], lambda a, f: F.zip_with(a, f, lambda x, y: F.least(x, y)))
    high = F.aggregate(F.slice(frames, 2, F.size(frames)), frames[0], lambda a, f: F.zip_with(a, f, lambda x, y: F.greatest(x, y)))
    return F.zip_with(high, low, lambda x, y: x - y)


def motion_score(frames: Column, ranges: Column, noise: int) -> Column:
    """Largest mean absolute change between frames over the active pixels, of 255 (AG10, AG11)."""
    live = F.transform(ranges, lambda r: (r > noise).cast("double"))
    n = F.aggregate(live, F.lit(0.0), lambda a, x: a + x)

    def change(i: Column) -> Column:
        diff = F.zip_with(F.get(frames, i), F.get(frames, i + 1), lambda x, y: F.abs(x - y))
        return F.aggregate(F.zip_with(diff, live, lambda d, m: d * m), F.lit(0.0), lambda a, x: a + x) / (n * 255)

    return F.when((F.size(frames) >= 2) & (n > 0), F.array_max(F.transform(F.sequence(F.lit(0), F.size(frames) - 2), change)))


def decide(windows: DataFrame, *, key: str = "camera_id", index: str = "w_index", frames: str = "frames", warmup: int = 2, noise: int = 16, min_px: int = 16, threshold: float = 0.05) -> DataFrame:
    """Adds passed, reason, score and active_px to windows with their frames.

    ``frames``: array of pixel arrays; null: no footage; empty: not decodable.
    The last frame of the window before is the reference of this one's first,
    unless that window had no frames.
    """
    prev = F.lag(F.when(F.size(frames) > 0, F.element_at(frames, -1))).over(Window.partitionBy(key).orderBy(index))
    seq = F.when(prev.isNotNull(), F.concat(F.array(prev), F.col(frames))).otherwise(F.col(frames))
    w = windows.withColumn("_seq", F.when(F.size(frames) > 0, seq))
    w = w.withColumn("_rng", F.when(F.size("_seq") >= 2, active_mask(F.col("_seq"))))
    w = w.withColumn("active_px", F.when(F.col("_rng").isNotNull(), F.size(F.filter("_rng", lambda r: r > noise))))
    score = F.when(F.col("active_px") < min_px, F.lit(0.0)).otherwise(motion_score(F.col("_seq"), F.col("_rng"), noise))
    w = w.withColumn("score", F.round(score, 9))
    reason = (
        F.when(F.col(index) < warmup, "warmup")
        .when(F.col(frames).isNull(), "no_footage")
        .when(F.col("score").isNull(), "undecodable")
        .when((F.col("active_px") >= min_px) & (F.col("score") >= threshold), "motion")
        .otherwise("still")
    )
    return w.withColumn("reason", reason).withColumn("passed", F.col("reason") != "still").drop("_seq", "_rng")
