"""From footage to index rows: settings, windows that are still to do, and what becomes of each window."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.functions.timefmt import chunk_id
from frameloom.operators import gate
from frameloom.operators.timeline import US, plan_windows, segment_of_instant


@dataclass(frozen=True)
class IngestSettings:
    """What an ingest run is told; see :meth:`problems`."""

    window_s: float = 5.0
    stride_s: float = 4.0
    sample_fps: float = 1.0
    gate_fps: float = 2.0
    threshold: float = 0.05
    thumbnail_px: int = 32
    warmup: int = 2
    noise: int = 16
    min_px: int = 16
    short_side: int = 512
    prompt: str = "describe"
    watchlist: bool = False
    watchlist_items: int = 8

    def problems(self) -> list[str]:
        """Every rule that is broken (F-V3); a wrong index is worse than none."""
        rules = {
            "window_s must be positive": self.window_s > 0,
            "stride_s must be positive": self.stride_s > 0,
            "stride_s must not exceed window_s, or footage between windows is never seen": self.stride_s <= self.window_s,
            "sample_fps must be positive": self.sample_fps > 0,
            "gate_fps must be positive": self.gate_fps > 0,
            "threshold must lie in 0..1": 0 <= self.threshold <= 1,
            "thumbnail_px must exceed 1": self.thumbnail_px > 1,
            "warmup must not be negative": self.warmup >= 0,
            "noise must be a grey level of 0..255": 0 <= self.noise <= 255,
            "min_px must fit into the thumbnail": 0 <= self.min_px <= self.thumbnail_px**2,
            "short_side must be positive": self.short_side > 0,
            "prompt must not be empty": bool(self.prompt.strip()),
            "watchlist_items must be positive": not self.watchlist or self.watchlist_items > 0,
        }
        return [text for text, holds in rules.items() if not holds]

    def checked(self) -> IngestSettings:
        if bad := self.problems():
            raise ValueError("; ".join(bad))
        return self


def scaled_size(width: Column, height: Column, short_side: int) -> Column:
    """``struct<width, height>`` of a picture brought to a short side, never enlarged; the other side is kept even (F-M5)."""
    if short_side <= 0:
        raise ValueError("short_side must be positive")
    small = F.least(F.lit(short_side), F.least(width, height)).cast("int")
    even = lambda long: (F.floor(long * small / F.least(width, height) / 2) * 2).cast("int")
    wide = width > height
    return F.struct(F.when(wide, even(width)).otherwise(small).alias("width"), F.when(wide, small).otherwise(even(height)).alias("height"))


def resume_points(chunks: DataFrame, key: str = "camera_id") -> DataFrame:
    """``(key, after_us)``: the end of the newest row by start of every camera (SC19); rows without times take no part."""
    rows = chunks.filter("start_us is not null and end_us is not null")
    return rows.groupBy(key).agg(F.max(F.struct("start_us", "end_us")).alias("m")).select(key, F.col("m.end_us").alias("after_us"))


def windows_to_do(segments: DataFrame, resume: DataFrame, o: IngestSettings, *, exclude_open: bool = True) -> DataFrame:
    """Complete windows of each camera's archive that start at or after its resume point, each once (ST2).

    ``segments``: camera_id, path, start_us, eff_end. Windows lie on a grid
    from the camera's first file, so that they are the same in every run; the
    newest file of a camera is still being written and left out.
    """
    o.checked()
    if exclude_open:
        newest = F.row_number().over(Window.partitionBy("camera_id").orderBy(F.desc("start_us"), F.desc("path"))) == 1
        segments = segments.withColumn("_newest", newest).filter(~F.col("_newest")).drop("_newest")
    spans = segments.groupBy("camera_id").agg(F.min("start_us").alias("start_us"), F.max("eff_end").alias("end_us"))
    rows = plan_windows(spans, o.window_s, o.stride_s).select("camera_id", "index", "w_start", "w_end")
    return rows.join(resume, "camera_id", "left").filter(F.col("after_us").isNull() | (F.col("w_start") >= F.col("after_us"))).drop("after_us")


def ingest(windows: DataFrame, segments: DataFrame, captions: DataFrame, o: IngestSettings | None = None) -> DataFrame:
    """One row per window with what becomes of it (Q14).

    ``windows``: camera_id, w_index, w_start, w_end, frames (see
    :func:`frameloom.operators.gate.decide`); ``segments``: camera_id, path,
    start_us, eff_end; ``captions``: camera_id, w_index, caption. ``outcome``:

    * ``no_footage``: no file covers the start; the window gets no index row.
    * ``skipped``: the gate held it back; a null row.
    * ``undecodable``: no frames, or no caption came back; a null row.
    * ``captioned``: a row with its caption, and no vector yet.

    A null row is gated, without caption; only windows that pass the gate look
    for a caption.
    """
    o = (o or IngestSettings()).checked()
    at = segment_of_instant(windows.select(F.concat_ws("|", "camera_id", "w_index").alias("key"), "camera_id", F.col("w_start").alias("t")), segments).filter("path is not null").select("key", F.col("path").alias("segment"), F.round("pts_offset", 3).alias("pts_offset"))
    rows = gate.decide(windows, warmup=o.warmup, noise=o.noise, min_px=o.min_px, threshold=o.threshold).withColumn("key", F.concat_ws("|", "camera_id", "w_index"))
    rows = rows.join(at, "key", "left").join(captions.select("camera_id", "w_index", "caption"), ["camera_id", "w_index"], "left")
    told = F.coalesce(F.trim("caption"), F.lit("")) != ""
    outcome = (
        F.when(F.col("segment").isNull(), "no_footage")
        .when(~F.col("passed"), "skipped")
        .when(~told | ~(F.coalesce(F.size("frames"), F.lit(0)) > 0), "undecodable")
        .otherwise("captioned")
    )
    start, end = F.timestamp_micros("w_start"), F.timestamp_micros("w_end")
    rows = rows.withColumn("outcome", outcome).withColumn("gated", F.col("outcome") != "captioned")
    return rows.select(chunk_id("camera_id", start, end).alias("chunk_id"), "camera_id", start.alias("t_start"), end.alias("t_end"), "segment", "pts_offset", F.lit("live").alias("tier"), "gated", F.when(~F.col("gated"), F.col("caption")).otherwise("").alias("caption"), F.array().cast("array<double>").alias("embedding"), "outcome", "reason", "score", "active_px")


def index_rows(ingested: DataFrame) -> DataFrame:
    """The rows of :func:`ingest` that go to the index."""
    return ingested.filter("outcome <> 'no_footage'").drop("outcome", "reason", "score", "active_px")


def import_place(duration_s: Column, now: Column, start: Column | None = None) -> Column:
    """``struct<t_start, t_end>`` of an import: it ends now unless its start is given; the start is cut to the second (Q30)."""
    us = F.round(duration_s * US).cast("long")
    begin = F.coalesce(start, F.timestamp_micros(F.unix_micros(now) - us)) if start is not None else F.timestamp_micros(F.unix_micros(now) - us)
    begin = F.date_trunc("second", begin)
    return F.struct(begin.alias("t_start"), F.timestamp_micros(F.unix_micros(begin) + us).alias("t_end"))


def slice_plan(slices: DataFrame, archive: DataFrame, name: Column) -> DataFrame:
    """Files of an import, named by the offsets that the cutter reported (SK13).

    ``slices``: camera_id, begin_us (of the import), start, end (seconds,
    reported); ``name`` makes the path of a row from camera_id and start_us. A
    path that the ``archive`` (path) has already is refused, never replaced.
    """
    rows = slices.withColumn("start_us", F.col("begin_us") + F.round(F.col("start") * US).cast("long")).withColumn("end_us", F.col("begin_us") + F.round(F.col("end") * US).cast("long")).filter("end_us > start_us")
    there = archive.select(F.col("path").alias("_there")).distinct()
    rows = rows.withColumn("path", name)
    return rows.join(there, F.col("path") == F.col("_there"), "left").withColumn("refused", F.col("_there").isNotNull()).drop("_there")


def frames_in_order(frames: DataFrame) -> DataFrame:
    """Frames ``(span_index, name)`` in wall-clock order: by span, then by the number in the name."""
    return frames.orderBy("span_index", F.regexp_extract("name", r"(\d+)\D*$", 1).cast("long"), "name")
