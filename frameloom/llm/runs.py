"""Runs of identical or near-identical consecutive events.

Events are written as a string of one code point each: an event that goes on
with its predecessor's run gets the predecessor's code point, others that of
their canonical form, with a break mark where that would join two runs. A
regular expression with a back reference finds the repetitions, and their
spans are mapped back to the rows.

A stream may hold a third of all events, so strings are made per (stream, time
bucket), each headed by the last event of the bucket before. Only the outer
runs of the buckets are stitched afterwards; their number follows the time
range.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameloom.llm.words import words
from frameloom.session import materialize

US = 1_000_000
_BREAK = "\x00"
_RUN = re.compile(r"([^\x00])\1*", re.DOTALL)
#: Stands for the run that is open where a string begins.
_OPEN = "\ue000"
#: Code points given to canonical events, from the first private-use plane on.
_FIRST, _LAST = 0xF0000, 0x10FFFD

PIECE = "key string, b bigint, i int, goes_on boolean, outer boolean, first_id string, t0 bigint, last_id string, t1 bigint, t_end bigint, n bigint, gated boolean, caption string"


def alike(x: frozenset, y: frozenset, num: int, den: int) -> bool:
    """Whether two word sets have a likeness of at least num / den; no words are like none."""
    if not x or not y:
        return False
    both = len(x & y)
    return both * den >= num * (len(x) + len(y) - both)


class _Bucket:
    """The state of the bucket that is being read; batches may end anywhere in it."""

    __slots__ = ("name", "prev", "open", "i")

    def __init__(self, name) -> None:
        self.name, self.prev, self.open, self.i = name, None, None, 0


def _encode(go_on: list[bool], canonical: list) -> tuple[str, list[int]]:
    """The string of symbols and the row of each of its characters."""
    table: dict = {}
    chars, row = [], []
    last = _BREAK
    for i, (g, c) in enumerate(zip(go_on, canonical)):
        if not g:
            s = table.get(c)
            if s is None:
                if len(table) > _LAST - _FIRST:
                    table.clear()
                s = table[c] = chr(_FIRST + len(table))
            if s == last:
                chars.append(_BREAK)
                row.append(-1)
            last = s
        elif last == _BREAK:
            last = _OPEN
        chars.append(last)
        row.append(i)
    return "".join(chars), row


def _find(num: int, den: int, gap_us: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket: _Bucket | None = None
        out: list[tuple] = []
        known: dict[str, frozenset] = {}

        def bag(text: str | None) -> frozenset:
            if not text:
                return frozenset()
            w = known.get(text)
            if w is None:
                if len(known) > 50_000:
                    known.clear()
                w = known[text] = frozenset(words(text))
            return w

        def close(b: _Bucket, outer: bool) -> None:
            if b.open:
                goes_on, *r = b.open
                out.append((*b.name, b.i, goes_on, outer or b.i == 0, *r))
                b.i += 1
                b.open = None

        def part(b: _Bucket, t: list, t_end: list, carry: list, ids: list, gated: list, caps: list) -> None:
            n = len(ids)
            go_on, canon = [False] * n, [None] * n
            p = b.prev
            drop = set()
            for i in range(n):
                if p is not None and not carry[i] and p[3] == ids[i] and not p[4]:
                    drop.add(i)  # a repeated row
                    go_on[i] = True
                    canon[i] = canon[i - 1] if i else None
                    continue
                w = None if gated[i] else bag(caps[i])
                if p is not None and t[i] - p[0] <= gap_us and p[1] == gated[i]:
                    go_on[i] = gated[i] or alike(p[2], w, num, den)
                canon[i] = True if gated[i] else w
                p = (t[i], gated[i], w, ids[i], carry[i])
            text, row = _encode(go_on, canon)
            first = True
            for m in _RUN.finditer(text):
                a, z = row[m.start()], row[m.end() - 1]
                rows = [i for i in range(a, z + 1) if i not in drop and not carry[i]]
                joins = first and go_on[0] and b.prev is not None  # goes on with the batch before, or with a carried event only
                if not (joins and b.open is not None):
                    close(b, False)
                first = False
                if not rows:
                    continue
                ends = [t_end[i] for i in rows if t_end[i] is not None]
                end = max(ends) if ends else None
                if b.open is None:
                    goes_on = bool(carry[a]) or (joins and b.i == 0)
                    b.open = [goes_on, ids[rows[0]], t[rows[0]], ids[rows[-1]], t[rows[-1]], end, len(rows), gated[rows[0]], caps[rows[0]]]
                else:
                    o = b.open
                    o[3], o[4], o[6] = ids[rows[-1]], t[rows[-1]], o[6] + len(rows)
                    o[5] = end if o[5] is None else o[5] if end is None else max(o[5], end)
            b.prev = p

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out))
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
            b = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in PIECE.split(", ")])
            out.clear()
            return b

        for batch in batches:
            if not batch.num_rows:
                continue
            col = {n: batch.column(n).to_pylist() for n in ("key", "b", "carry", "t", "id", "gated", "t_end", "caption")}
            cells = list(zip(col["key"], col["b"]))
            at = 0
            bounds = np.flatnonzero([x != y for x, y in zip(cells, cells[1:])]) + 1
            for z in [*bounds.tolist(), len(cells)]:
                if bucket is None or bucket.name != cells[at]:
                    if bucket is not None:
                        close(bucket, True)
                    bucket = _Bucket(cells[at])
                part(bucket, *(col[n][at:z] for n in ("t", "t_end", "carry", "id", "gated", "caption")))
                at = z
            if len(out) >= 4096:
                yield flush()
        if bucket is not None:
            close(bucket, True)
        if out:
            yield flush()

    return run


def event_runs(events: DataFrame, *, likeness: tuple[int, int] = (7, 10), gap_s: float = 600, bucket_s: float = 3600, least: int = 2) -> DataFrame:
    """Maximal runs ``(key, first_id, last_id, start_us, end_us, duration_s, n, gated, caption)`` of at least ``least`` events.

    ``events``: key, t (bigint microseconds), id, gated, t_end (bigint or
    null), caption. Ordered by t, then id. An event goes on with its
    predecessor's run if it starts at most ``gap_s`` after it and both are
    gated, or neither is and their captions' likeness reaches the threshold; a
    null or wordless caption is like none. Rows with a null key, t, id or
    gated take no part; a repeated id of a stream counts once. A run lasts
    from its first t to its latest t_end (null if none has one). ``caption``
    is that of its first event.
    """
    num, den = likeness
    rows = (
        events.filter("key is not null and t is not null and id is not null and gated is not null")
        .select(F.col("key").cast("string").alias("key"), F.floor(F.col("t") / F.lit(int(bucket_s * US))).cast("long").alias("b"), F.lit(0).alias("carry"), F.col("t").cast("long").alias("t"), F.col("id").cast("string").alias("id"), "gated", F.col("t_end").cast("long").alias("t_end"), F.when(~F.col("gated"), F.col("caption").cast("string")).alias("caption"))
    )
    by_key = Window.partitionBy("key").orderBy("b")
    last = rows.groupBy("key", "b").agg(F.max(F.struct("t", "id", "gated", "caption")).alias("r"))
    carried = last.select("key", F.lead("b").over(by_key).alias("b"), F.lit(1).alias("carry"), "r.t", "r.id", "r.gated", F.lit(None).cast("long").alias("t_end"), "r.caption").filter("b is not null")
    pieces = rows.unionByName(carried).repartition("key", "b").sortWithinPartitions("key", "b", "t", "id").mapInArrow(_find(num, den, int(gap_s * US)), PIECE)
    pieces = materialize(pieces, "runs")
    outer = pieces.filter("outer")
    group = Window.partitionBy("key").orderBy("b", "i").rowsBetween(Window.unboundedPreceding, 0)
    whole = (
        outer.withColumn("g", F.sum((~F.col("goes_on")).cast("int")).over(group))
        .groupBy("key", "g")
        .agg(F.min_by("first_id", F.struct("b", "i")).alias("first_id"), F.max_by("last_id", F.struct("b", "i")).alias("last_id"), F.min("t0").alias("t0"), F.max("t_end").alias("t_end"), F.sum("n").alias("n"), F.min_by("gated", F.struct("b", "i")).alias("gated"), F.min_by("caption", F.struct("b", "i")).alias("caption"))
    )
    cols = ["key", "first_id", "last_id", "t0", "t_end", "n", "gated", "caption"]
    out = pieces.filter("not outer").select(*cols).unionByName(whole.select(*cols)).filter(F.col("n") >= least)
    return out.select("key", "first_id", "last_id", F.col("t0").alias("start_us"), F.col("t_end").alias("end_us"), ((F.col("t_end") - F.col("t0")) / 1e6).alias("duration_s"), "n", "gated", "caption")
