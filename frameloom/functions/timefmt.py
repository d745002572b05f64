"""Time, name and key formats as Column expressions; times are timestamps of a session in UTC."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ts(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("timestamp")


def iso(c: Column | str) -> Column:
    """ISO 8601 with Z; microseconds only if there are any (F-D1)."""
    t = _ts(c)
    whole = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    us = F.pmod(F.unix_micros(t), F.lit(1_000_000))
    return F.when(us == 0, F.concat(whole, F.lit("Z"))).otherwise(F.concat(whole, F.lit("."), F.lpad(us.cast("string"), 6, "0"), F.lit("Z")))


def chunk_id(camera: Column | str, start: Column | str, end: Column | str) -> Column:
    """``<camera>_<yyyymmddThhmmss>_<hhmmss>`` in whole seconds (F-D2)."""
    cam = F.col(camera) if isinstance(camera, str) else camera
    return F.concat(cam, F.lit("_"), F.date_format(_ts(start), "yyyyMMdd'T'HHmmss"), F.lit("_"), F.date_format(_ts(end), "HHmmss"))


def segment_name(camera: Column | str, start: Column | str) -> Column:
    """``<camera>_<yyyymmdd>_<hhmmss>.mp4``."""
    cam = F.col(camera) if isinstance(camera, str) else camera
    return F.concat(cam, F.lit("_"), F.date_format(_ts(start), "yyyyMMdd_HHmmss"), F.lit(".mp4"))


def clip_path(camera: Column | str, start: Column | str, end: Column | str, folder: str = "data/clips") -> Column:
    """Deterministic path of the clip of a range."""
    return F.concat(F.lit(folder + "/"), chunk_id(camera, start, end), F.lit(".mp4"))


def seconds_between(a: Column | str, b: Column | str) -> Column:
    """Seconds from a to b, exact to the microsecond (F-D4)."""
    return (F.unix_micros(_ts(b)) - F.unix_micros(_ts(a))) / F.lit(1e6)


def pts_offset(t: Column | str, start: Column | str, most: float = 62.0) -> Column:
    """Seconds of an instant into its segment; null outside 0..most."""
    s = seconds_between(start, t)
    return F.when((s >= 0) & (s <= most), s)


def local_time(c: Column | str, zone: str, form: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """A UTC time written in a zone (F-D3)."""
    return F.date_format(F.from_utc_timestamp(_ts(c), zone), form)


def countdown(seconds: Column) -> Column:
    """Whole seconds left, never below 0 (F-D7)."""
    return F.greatest(F.lit(0), F.ceil(seconds)).cast("long")


def backoff(attempt: Column, initial: float = 1.0, factor: float = 2.0, most: float = 60.0) -> Column:
    """Delay before a further attempt, counted from 1 (F-M3)."""
    return F.least(F.lit(most), F.lit(initial) * F.pow(F.lit(factor), attempt - 1))


# What stands around the task and range in an alert's key, and the name of an alert without a task.
KEY_HEAD, KEY_TAIL, KEY_NO_TASK = "spark-", "-v1-discord", "ad-hoc"


def idempotency_key(task: Column, start: Column, end: Column, most: int = 128) -> Column:
    """Key of an alert: its task and its footage range (F-K1)."""
    form = "yyyyMMdd'T'HHmmss"
    name = F.when(F.coalesce(task, F.lit("")) == "", F.lit(KEY_NO_TASK)).otherwise(task)
    raw = F.concat(F.lit(KEY_HEAD), name, F.lit("-"), F.date_format(_ts(start), form), F.lit("-"), F.date_format(_ts(end), form), F.lit(KEY_TAIL))
    return F.substring(F.regexp_replace(F.regexp_replace(raw, "[^A-Za-z0-9._-]+", "-"), "^-+|-+$", ""), 1, most)


def scene_number(c: Column, scenes: int = 8) -> Column:
    """Which canned scene an id stands for (F-K3)."""
    return F.pmod(F.conv(F.substring(F.sha2(c, 256), 1, 2), 16, 10).cast("int"), F.lit(scenes))


def active_minutes(spec: Column | str) -> Column:
    """``struct(start, end)`` in minutes of a window ``HH:MM-HH:MM``; null if it is none (F-D8)."""
    s = F.trim(F.col(spec) if isinstance(spec, str) else spec)
    parts = F.when(s.rlike(r"^\d{1,2}:\d{2}-\d{1,2}:\d{2}$"), F.split(F.translate(s, "-", ":"), ":").cast("array<int>"))

    def window(p: Column) -> Column:
        time = lambda h, m: (m <= 59) & ((h < 24) | ((h == 24) & (m == 0)))
        return F.when(time(p[0], p[1]) & time(p[2], p[3]), F.struct((p[0] * 60 + p[1]).alias("start"), (p[2] * 60 + p[3]).alias("end")))

    # Bound once by the lambda, so that the parsing is not repeated in the plan.
    return F.get(F.transform(F.array(parts), window), F.lit(0))


def local_minute(t: Column | str, zone: str) -> Column:
    """Minute of the local day."""
    local = F.from_utc_timestamp(_ts(t), zone)
    return F.hour(local) * 60 + F.minute(local)


def minute_within(start: Column, end: Column, t: Column | str, zone: str) -> Column:
    """Whether the local time lies in ``[start, end)`` of minutes; wraps midnight, equal ends mean all day; null without a window."""
    return minute_in(start, end, local_minute(t, zone))


def minute_in(start: Column, end: Column, m: Column) -> Column:
    """:func:`minute_within` of a minute that is known."""
    whole = (start == end) | ((start == 0) & (end == 1440))
    return F.when(whole, True).when(start < end, (m >= start) & (m < end)).when(start.isNotNull() & end.isNotNull(), (m >= start) | (m < end))


def in_active_window(spec: Column | str, t: Column | str, zone: str) -> Column:
    """Whether the local time of ``t`` lies in a window ``HH:MM-HH:MM``.

    Parse the window before a join with :func:`active_minutes` and use
    :func:`minute_within` where many times meet few windows.
    """
    w = active_minutes(spec)
    return minute_within(w["start"], w["end"], t, zone)


#: The directives of a file-name pattern.
_DIRECTIVES = {"Y": r"\d{4}", "m": r"\d{2}", "d": r"\d{2}", "H": r"\d{2}", "M": r"\d{2}", "S": r"\d{2}", "y": r"\d{2}", "j": r"\d{3}", "f": r"\d{1,6}"}


def name_pattern(pattern: str) -> tuple[str, list[str]]:
    """A regular expression of a file-name pattern such as ``{camera_id}_%Y%m%d_%H%M%S.mp4`` and its groups' names (SC6).

    Unknown directives and a pattern without a year raise.
    """
    out, names, i = "^", [], 0
    while i < len(pattern):
        if pattern.startswith("{camera_id}", i):
            out, i = out + "(.+?)", i + len("{camera_id}")
            names.append("camera_id")
        elif pattern[i] == "%":
            d = pattern[i + 1 : i + 2]
            if d == "%":
                out += "%"
            elif d in _DIRECTIVES:
                out += f"({_DIRECTIVES[d]})"
                names.append(d)
            else:
                raise ValueError(f"unknown directive %{d} in {pattern!r}")
            i += 2
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    if not {"Y", "y"} & set(names):
        raise ValueError(f"pattern {pattern!r} has no year")
    return out + "$", names


def name_parts(name: Column | str, pattern: str) -> Column:
    """``struct(camera_id, start)`` of a file name; null where it does not match (SC7)."""
    c = F.col(name) if isinstance(name, str) else name
    rx, names = name_pattern(pattern)
    part = lambda n: F.regexp_extract(c, rx, names.index(n) + 1) if n in names else F.lit("00" if n in "HMS" else "01")
    year = part("Y") if "Y" in names else F.concat(F.lit("20"), part("y"))
    day = F.concat_ws("-", year, part("m"), part("d"))
    start = F.try_to_timestamp(F.concat_ws(" ", day, F.concat_ws(":", part("H"), part("M"), part("S"))), F.lit("yyyy-MM-dd HH:mm:ss"))
    cam = part("camera_id") if "camera_id" in names else F.lit("")
    return F.when(c.rlike(rx) & start.isNotNull(), F.struct(cam.alias("camera_id"), start.alias("start")))
