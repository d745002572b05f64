"""References to keys that are missing, taken away or came later.

Keys of all targets share one order: the 64-bit hash of (field, key). That
space is cut into equal ranges. The parents of a range form sorted arrays in
the task that owns it; the references of the range stream past in Arrow
batches and are found by binary search, all of a batch at once. A range that
many references name is cut into salted parts, each with its own copy of the
(bounded) parent arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.session import cut

OUT = "src string, field string, rec_id string, state string, ts bigint"
_COLS = ["cell", "kind", "h", "field", "key", "src", "rec_id", "ts", "present", "removed", "gone_at", "since"]


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parents of a cell come before its references; both are in order of the hash."""
    cell, parts, arrays = None, [], None
    for batch in batches:
        cells = batch.column("cell").to_numpy(zero_copy_only=False)
        kinds = batch.column("kind").to_numpy(zero_copy_only=False)
        if not len(cells):
            continue
        cuts = np.flatnonzero((np.diff(cells) != 0) | (np.diff(kinds) != 0)) + 1
        for a, z in zip([0, *cuts], [*cuts, len(cells)]):
            piece = batch.slice(a, z - a)
            if cells[a] != cell:
                cell, parts, arrays = cells[a], [], None
            if kinds[a] == 0:
                parts.append(piece)
                continue
            if arrays is None:
                t = pa.Table.from_batches(parts) if parts else None
                arrays = (np.empty(0, np.int64), None) if t is None else (t["h"].to_numpy(), t)
            out = _states(piece, *arrays)
            if out.num_rows:
                yield out


def _states(refs: pa.RecordBatch, hashes: np.ndarray, parents: pa.Table | None) -> pa.RecordBatch:
    n = refs.num_rows
    ts = refs.column("ts")
    at = np.full(n, -1)
    if parents is not None:
        lo = np.searchsorted(hashes, refs.column("h").to_numpy(zero_copy_only=False), side="left")
        todo = np.arange(n)
        h = refs.column("h").to_numpy(zero_copy_only=False)
        # Equal hashes of different keys stand next to each other; step on until the key itself agrees.
        while len(todo):
            todo = todo[(lo[todo] < len(hashes))]
            todo = todo[hashes[lo[todo]] == h[todo]]
            if not len(todo):
                break
            same = np.array(pc.and_(pc.equal(parents["key"].take(pa.array(lo[todo])), pa.chunked_array([refs.column("key")]).take(pa.array(todo))), pc.equal(parents["field"].take(pa.array(lo[todo])), pa.chunked_array([refs.column("field")]).take(pa.array(todo)))).to_pylist(), dtype=bool)
            at[todo[same]] = lo[todo[same]]
            todo = todo[~same]
            lo[todo] += 1
    found = at >= 0

    def fact(name: str, empty):
        if parents is None:
            return np.full(n, empty)
        got = pc.fill_null(parents[name], empty).to_numpy()
        return np.where(found, got[np.where(found, at, 0)], empty) if len(got) else np.full(n, empty)

    big = np.int64(2**62)
    when = pc.fill_null(ts, -big).to_numpy(zero_copy_only=False)
    present, removed = fact("present", False).astype(bool), fact("removed", False).astype(bool)
    gone_at, since = fact("gone_at", big), fact("since", -big)
    dated = ts.is_valid().to_numpy(zero_copy_only=False)
    retired = found & (gone_at < big)
    state = np.full(n, None, dtype=object)
    state[~found | (~present & ~retired)] = "missing"
    state[present & ~retired & dated & (since > when)] = "late"
    state[retired & dated & (gone_at <= when)] = "removed"
    state[removed] = "removed"
    keep = pa.array(state != None)  # noqa: E711
    cols = [refs.column("src"), refs.column("field"), refs.column("rec_id"), pa.array(state, pa.string()), ts]
    return pa.RecordBatch.from_arrays([c.filter(keep) for c in cols], names=["src", "field", "rec_id", "state", "ts"])


def find_orphans(refs: DataFrame, parents: DataFrame, *, parents_per_range: int = 20_000, refs_per_part: int = 100_000) -> DataFrame:
    """``(src, field, rec_id, state, ts)`` of every reference that is an orphan.

    ``refs``: src, field, rec_id, key, ts (bigint or null). ``parents``: field,
    key, present (the key is in the target), removed (taken away, whenever),
    gone_at (taken away from then on), since (there from then on); of several
    rows of a key, any ``present`` or ``removed`` and the earliest times hold.

    Null and empty keys are no references. States in order of precedence:
    ``removed`` (taken away, or gone at or before ts), none at all for a key
    that goes later, ``missing`` (not present), ``late`` (since after ts). A
    reference without a time is neither late nor gone.
    """
    pos = lambda c: F.xxhash64("field", c)
    p = (
        parents.filter("key is not null and key <> ''")
        .groupBy("field", "key")
        .agg(F.max("present").alias("present"), F.max("removed").alias("removed"), F.min("gone_at").alias("gone_at"), F.min("since").alias("since"))
    )
    p = cut(p.withColumn("h", pos("key")))
    n_ranges = max(1, -(-p.count() // parents_per_range))
    rng = (F.shiftrightunsigned("h", 33) * F.lit(n_ranges) / F.lit(2**31)).cast("int")
    r = refs.filter("key is not null and key <> ''").withColumn("h", pos("key")).withColumn("rng", rng)
    # One count per range: which ranges are hot.
    load = r.groupBy("rng").count().select("rng", F.ceil(F.col("count") / F.lit(refs_per_part)).cast("int").alias("parts"))
    load = F.broadcast(load)  # at most n_ranges rows of two ints; n_ranges = parents / parents_per_range
    cells = lambda salt: (F.col("rng").cast("long") * F.lit(2**31) + salt).alias("cell")
    left = r.join(load, "rng").select(
        cells(F.pmod(F.xxhash64("src", "rec_id"), F.col("parts")).cast("long")), F.lit(1).alias("kind"), "h", "field", "key", "src", "rec_id", "ts", F.lit(None).cast("boolean").alias("present"), F.lit(None).cast("boolean").alias("removed"), F.lit(None).cast("long").alias("gone_at"), F.lit(None).cast("long").alias("since")
    )
    right = (
        p.withColumn("rng", rng)
        .join(load, "rng")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(cells(F.col("salt").cast("long")), F.lit(0).alias("kind"), "h", "field", "key", F.lit(None).cast("string").alias("src"), F.lit(None).cast("string").alias("rec_id"), F.lit(None).cast("long").alias("ts"), "present", "removed", "gone_at", "since")
    )
    return right.select(*_COLS).unionByName(left.select(*_COLS)).repartition("cell").sortWithinPartitions("cell", "kind", "h").mapInArrow(_probe, OUT)


def count_by_day(orphans: DataFrame) -> DataFrame:
    """Orphans per source, field, state and UTC day of the reference (null day: no time)."""
    day = F.to_date(F.timestamp_micros("ts"))
    return orphans.groupBy("src", "field", "state", day.alias("day")).agg(F.count(F.lit(1)).alias("n"))
