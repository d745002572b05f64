"""Activity sessions per entity, kept in an incrementally updated table.

A batch's events are grouped to local sessions, the stored sessions that lie
within the gap of a local one are fetched, bridged ones are merged, and the
affected rows are replaced by one atomic publication.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameloom.session import cut, scratch_path
from frameloom.sources.snapshot import SnapshotTable

US = 1_000_000
DAY_US = 86_400 * US



def _merge(rows: DataFrame, gap_us: int, bucket_us: int) -> DataFrame:
    """Merge ``(key, first, last, n)`` rows whose spans lie within the gap of each other.

    Works on (key, time bucket) groups, so a hot key is spread; only the two
    outer pieces of each group meet in one ordered pass per key, and their
    number follows the time range.
    """
    rows = rows.select("key", "first", "last", "n", F.floor(F.col("first.t") / F.lit(bucket_us)).cast("long").alias("b"))
    by_key = Window.partitionBy("key").orderBy("b")
    carry = rows.groupBy("key", "b").agg(F.max("last.t").alias("m")).select("key", "b", F.max("m").over(by_key.rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    group = Window.partitionBy("key", "b").orderBy("first", "last")
    labelled = (
        rows.join(carry, ["key", "b"])
        .withColumn("p", F.greatest("carry", F.max("last.t").over(group.rowsBetween(Window.unboundedPreceding, -1))))
        .withColumn("brk", (F.col("p").isNull() | (F.col("first.t") > F.col("p") + F.lit(gap_us))).cast("int"))
        .withColumn("isl", F.sum("brk").over(group.rowsBetween(Window.unboundedPreceding, 0)))
    )
    pieces = cut(labelled.groupBy("key", "b", "isl").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n")))
    # A piece numbered 0 goes on with the last piece of an earlier group.
    last_isl = pieces.groupBy("key", "b").agg(F.max("isl").alias("top"))
    anchors = last_isl.select("key", "b", F.last(F.when(F.col("top") > 0, F.struct("b", "top")), ignorenulls=True).over(by_key.rowsBetween(Window.unboundedPreceding, -1)).alias("a"))
    return (
        pieces.join(anchors, ["key", "b"])
        .select("key", "first", "last", "n", F.when(F.col("isl") > 0, F.struct(F.col("b").alias("b"), F.col("isl").alias("top"))).otherwise(F.col("a")).alias("a"))
        .groupBy("key", "a")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
        .drop("a")
    )


def local_sessions(events: DataFrame, gap_us: int, bucket_us: int = 3600 * US) -> DataFrame:
    """Sessions ``(key, first, last, n)`` of distinct ``(key, t, id)`` events."""
    edge = F.struct(F.col("t").cast("long").alias("t"), F.col("id").cast("string").alias("id"))
    return _merge(events.select(F.col("key").cast("string").alias("key"), edge.alias("first"), edge.alias("last"), F.lit(1).cast("long").alias("n")), gap_us, bucket_us)


#: Folders of a day's counted events before they are written together.
_MOST_FOLDERS = 16


class SessionTable:
    """The stored sessions and the events already counted, as one published table in the shared folder.

    Part 2 d holds the sessions that begin on day d, part 2 d + 1 the events of
    day d; with every part of sessions goes its earliest start and latest end.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, *, gap_s: float = 60, bucket_s: float = 3600) -> None:
        self.spark, self.gap_us, self.bucket_us = spark, int(gap_s * US), int(bucket_s * US)
        edge = "struct<t:bigint,id:string>"
        self.table = SnapshotTable(spark, root or scratch_path(spark, "sessions"), T.StructType.fromDDL(f"key string, first {edge}, last {edge}, n bigint, id string, t bigint, part bigint"))

    def apply(self, events: DataFrame) -> None:
        """Merge one batch of ``(key, t, id)`` events and publish sessions and counted events together.

        Rows with a null key, time or id take no part; an event, that is an id
        at a time, counts once, in this batch and in all earlier ones (under
        the least key, should it come with several); an empty batch changes
        nothing. A batch that failed may be applied again. Only the days of the
        batch, and those of stored sessions within the gap of it, are read.
        """
        new = events.select(F.col("key").cast("string").alias("key"), F.col("t").cast("long").alias("t"), F.col("id").cast("string").alias("id")).filter("key is not null and t is not null and id is not null").groupBy("id", "t").agg(F.min("key").alias("key"))
        day = lambda c: F.floor(c / F.lit(DAY_US)).cast("long")
        stored = self.table.manifest()
        if stored:
            new = cut(new)
            mine = {2 * r[0] + 1 for r in new.select(day(F.col("t")).alias("d")).distinct().collect()}  # bounded by the time range
            if mine & {int(k) for k in stored}:
                new = new.join(self.table.read(mine).select("id", "t"), ["id", "t"], "left_anti")
        new = cut(new)
        days = {r[0] for r in new.select(day(F.col("t")).alias("d")).distinct().collect()}
        if not days:
            return
        local = cut(local_sessions(new, self.gap_us, self.bucket_us))
        facts = self.table.facts()
        reach = lambda span: any(span[0] <= (d + 1) * DAY_US + self.gap_us and span[1] >= d * DAY_US - self.gap_us for d in days)
        near = {p for p, span in facts.items() if reach(span)}
        sessions, changed = local, set()
        if near:
            old = self.table.read(near).select("key", "first", "last", "n")
            cells = lambda df, pad: df.select("key", "first", "last", F.explode(F.sequence(self._cell(F.col("first.t") - pad), self._cell(F.col("last.t") + pad))).alias("cell"))
            reached = cells(local, self.gap_us)
            touched = cut(cells(old, 0).join(reached.select("key", "cell").distinct(), ["key", "cell"], "left_semi").select("key", "first", "last").distinct())
            linked = reached.join(cells(touched, 0).select("key", "cell").distinct(), ["key", "cell"], "left_semi").select("key", "first", "last").distinct()
            changed = {2 * r[0] for r in touched.select(day(F.col("first.t")).alias("d")).distinct().collect()}
        changed |= {2 * r[0] for r in local.select(day(F.col("first.t")).alias("d")).distinct().collect()} & set(facts)
        if near:
            same = ["key", "first", "last"]
            rest = self.table.read(changed).select("key", "first", "last", "n").join(touched, same, "left_anti")
            merged = _merge(old.join(touched, same, "left_semi").unionByName(local.join(linked, same, "left_semi")), self.gap_us, self.bucket_us)
            sessions = rest.unionByName(merged).unionByName(local.join(linked, same, "left_anti"))
        sessions = cut(sessions.withColumn("part", 2 * day(F.col("first.t"))))
        spans = {r[0]: [r[1], r[2]] for r in sessions.groupBy("part").agg(F.min("first.t"), F.max("last.t")).collect()}
        counted = {2 * d + 1 for d in days}
        full = {p for p in counted if len(stored.get(str(p), [])) >= _MOST_FOLDERS}
        seen = new.select("id", "t")
        if full:
            seen = seen.unionByName(self.table.read(full).select("id", "t"))
        seen = seen.withColumn("part", 2 * day(F.col("t")) + 1)
        self.table.replace(sessions.unionByName(seen, allowMissingColumns=True), changed | full, facts=spans, extended=counted - full)

    def _cell(self, c: Column) -> Column:
        return F.floor(c / F.lit(self.bucket_us)).cast("long")

    def read(self) -> DataFrame:
        """``(key, first, last, n)`` of all sessions."""
        return self.table.read({p for p in self.table.parts() if p % 2 == 0}).select("key", "first", "last", "n")
