"""Canonical keys: how ids and file names of different writings are made equal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters dropped around a key.
BLANKS = " \t\n\r\f\v "


def canon_id(c: Column | str) -> Column:
    """Trimmed and lower-case; null stays null, blank becomes the empty string."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.btrim(c, F.lit(BLANKS)))


def canon_file(c: Column | str) -> Column:
    """The part of a path after its last ``/``, as :func:`canon_id` writes it."""
    c = F.col(c) if isinstance(c, str) else c
    return canon_id(F.element_at(F.split(c, "/"), -1))


def micros(c: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone (session zone UTC)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_micros(c.cast("timestamp"))
