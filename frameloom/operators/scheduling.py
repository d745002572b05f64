"""A priority queue with bounded pauses, replayed over arrivals (O6, ST11, AG16)."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

US = 1_000_000
#: Lanes in order of priority with the longest pause of their head in seconds (None: no limit).
LANES = (("interactive", None), ("verification", None), ("ingest", 5.0))

SCHEDULE = "queue string, id string, lane int, arrived bigint, started bigint, wait_s double, overdue boolean"


class Replay:
    """One server: overdue heads first (longest wait, then lane), else the first lane that waits, in order of arrival."""

    def __init__(self, caps: list[int | None]) -> None:
        self.caps, self.lanes, self.free = caps, [deque() for _ in caps], 0

    def _next(self, now: int) -> tuple[int, bool] | None:
        starved = [(lane[0][0], r) for r, lane in enumerate(self.lanes) if lane and self.caps[r] is not None and now - lane[0][0] >= self.caps[r]]
        if starved:
            return min(starved)[1], True
        return next(((r, False) for r, lane in enumerate(self.lanes) if lane), None)

    def until(self, now: int | None) -> Iterator[tuple]:
        """Starts that happen before ``now`` (None: all that are left)."""
        while any(self.lanes):
            at = max(self.free, min(lane[0][0] for lane in self.lanes if lane))
            if now is not None and at >= now:
                return
            lane, overdue = self._next(at)
            arrived, ident, service = self.lanes[lane].popleft()
            self.free = at + service
            yield ident, lane, arrived, at, overdue


def replay(arrivals: DataFrame, lanes=LANES) -> DataFrame:
    """Schedule of ``(queue, id, lane, arrived, service_us)``; lane is a position in ``lanes``.

    Rows of one queue are one stream in order of (arrived, lane, id); every
    start depends on the ones before, so a queue is replayed by one task, which
    holds only what waits. Rows with a null queue, lane or arrival take no part.
    """
    caps = [None if c is None else int(c * US) for _, c in lanes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, q, out = None, None, []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out))
            out.clear()
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in SCHEDULE.split(", ")])

        def note(rows) -> None:
            out.extend((name, i, lane, a, s, (s - a) / 1e6, o) for i, lane, a, s, o in rows)

        for b in batches:
            for queue, ident, lane, arrived, service in zip(*(b.column(c).to_pylist() for c in ("queue", "id", "lane", "arrived", "service_us"))):
                if queue != name:
                    if q is not None:
                        note(q.until(None))
                    name, q = queue, Replay(caps)
                note(q.until(arrived))
                q.lanes[lane].append((arrived, ident, service))
            if len(out) > 8192:
                yield flush()
        if q is not None:
            note(q.until(None))
        if out:
            yield flush()

    rows = arrivals.filter("queue is not null and lane is not null and arrived is not null").select("queue", "id", F.col("lane").cast("int").alias("lane"), F.col("arrived").cast("long").alias("arrived"), F.col("service_us").cast("long").alias("service_us"))
    return rows.repartition("queue").sortWithinPartitions("queue", "arrived", "lane", "id").mapInArrow(run, SCHEDULE)


def queue_stats(schedule: DataFrame) -> DataFrame:
    """Completed, longest wait and overdue starts per lane (AG16)."""
    return schedule.groupBy("lane").agg(F.count(F.lit(1)).alias("completed"), F.max("wait_s").alias("max_wait_s"), F.count_if("overdue").alias("promotions"))


def in_flight_duplicates(jobs: DataFrame) -> DataFrame:
    """Jobs that ask for a range that is already in flight attach to the running one (ST9).

    ``jobs``: job_id, range_key, requested_us, completed_us (null: still
    running). Adds ``attached_to``, the job that runs, or null. Decisions of a
    range depend on each other and are replayed in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, holder, until = object(), None, None
        for b in batches:
            att = []
            for k, job, a, z in zip(*(b.column(c).to_pylist() for c in ("range_key", "job_id", "requested_us", "completed_us"))):
                if k != key:
                    key, holder, until = k, None, -(2**62)
                if a < until:
                    att.append(holder)
                else:
                    att.append(None)
                    holder, until = job, 2**62 if z is None else z
            yield pa.RecordBatch.from_arrays([b.column("job_id"), b.column("range_key"), pa.array(att, pa.string())], names=["job_id", "range_key", "attached_to"])

    rows = jobs.filter("range_key is not null and requested_us is not null").select("range_key", "job_id", "requested_us", "completed_us")
    return rows.repartition("range_key").sortWithinPartitions("range_key", "requested_us", "job_id").mapInArrow(run, "job_id string, range_key string, attached_to string")
