"""Rebuild the current state from a feed of inserts, amendments and retractions, batch by batch.

The table holds every entry in the bucket of its id, with the original its
parents lead to, and next to them, for each original, the latest of the
bucket's entries. A batch is joined with the buckets it touches; each of those
is rebuilt in one task by an embedded DuckDB upsert, in which a conflicting row
replaces the stored one only if its sequence comes first, and all rebuilt
buckets are published by one manifest. Entries whose parents are not there yet
wait in their buckets and are led to their original by the batch that brings
them.

Since entries lie by their own ids, an original with a third of all entries is
spread over all buckets; a reader takes the latest of at most one row per
bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameloom.session import cut, discard, input_cores, materialize, scratch_path
from frameloom.sources.snapshot import SnapshotTable

#: kind 0: an entry; kind 1: the latest entry of an original within the bucket.
STATE = "kind int, entry_id string, seq bigint, parent_id string, status string, root string, bucket bigint"
_NO_TIME = -(2**62)


def distinct_entries(feed: DataFrame) -> DataFrame:
    """One row of each entry id, at its earliest time (a null time counts only if it has no other)."""
    rows = feed.filter(F.col("entry_id").isNotNull()).select("entry_id", F.struct(F.coalesce(F.col("ts"), F.lit(2**62)).alias("ts"), "parent_id", "status").alias("r"))
    return rows.groupBy("entry_id").agg(F.min("r").alias("r")).select("entry_id", F.when(F.col("r.ts") < 2**62, F.col("r.ts")).alias("ts"), "r.parent_id", "r.status")


def resolve_roots(entries: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``(entry_id, root, ts, status)`` of the entries whose parents lead to an original.

    ``known`` (entry_id, root) are entries, not among these, whose original is
    known already. Pointer doubling: each round halves the way that is left.
    Entries on or behind a cycle, or whose parents end nowhere, lead to none.
    Rounds end when a round settles nothing more, as only cycles are then left.
    """
    nodes = entries.select("entry_id", "ts", "parent_id", "status")
    if known is None:
        nodes = nodes.withColumn("root", F.when(F.col("parent_id").isNull(), F.col("entry_id")))
    else:
        nodes = nodes.join(known.select(F.col("entry_id").alias("parent_id"), F.col("root").alias("_root")), "parent_id", "left").withColumn("root", F.when(F.col("parent_id").isNull(), F.col("entry_id")).otherwise(F.col("_root"))).drop("_root")
    nodes = cut(nodes)
    settled = nodes.filter("root is not null").select("entry_id", "root", "ts", "status")
    open_ = nodes.filter("root is null").select("entry_id", F.col("parent_id").alias("ptr"), "ts", "status")
    # Where a pointer stands: at an entry that is settled, or at one whose pointer goes on.
    jump = settled.select(F.col("entry_id").alias("at"), "root", F.lit(None).cast("string").alias("to")).unionByName(open_.select(F.col("entry_id").alias("at"), F.lit(None).cast("string").alias("root"), F.col("ptr").alias("to")))
    done, left = [settled], None
    while True:
        step = cut(open_.join(jump, open_.ptr == jump["at"]).select("entry_id", "root", "to", "ts", "status"))
        done.append(step.filter("root is not null").select("entry_id", "root", "ts", "status"))
        going = step.filter("root is null")
        n = going.count()
        if n == 0 or n == left:
            break
        left = n
        open_ = going.select("entry_id", F.col("to").alias("ptr"), "ts", "status")
        # Doubling: an unfinished pointer now jumps twice as far.
        jump = going.select(F.col("entry_id").alias("at"), F.lit(None).cast("string").alias("root"), "to")
        for d in done:
            jump = jump.unionByName(d.select(F.col("entry_id").alias("at"), "root", F.lit(None).cast("string").alias("to")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _upsert_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stored entries and new rows of the buckets of a task to their new entries and latest rows."""
    import duckdb

    # A task holds one bucket, whose rows are bounded; nothing may spill into the executor's working folder.
    con = duckdb.connect(":memory:", config={"threads": 1, "temp_directory": "", "memory_limit": "1GB"})
    con.execute("create table entries (entry_id varchar primary key, seq bigint, parent_id varchar, status varchar, root varchar, bucket bigint)")
    some = False
    for batch in batches:
        if not batch.num_rows:
            continue
        some = True
        con.register("feed", pa.Table.from_batches([batch]))
        # A statement may meet a key once, so a batch is first reduced to the first row of each entry. A stored row gives way
        # to one that comes before it, or to itself once its original is known.
        con.execute(
            """insert into entries
               select entry_id, seq, parent_id, status, root, bucket from feed
               qualify row_number() over (partition by entry_id order by case when seq = -(2**62)::bigint then (2**62)::bigint else seq end, coalesce('1' || parent_id, '0'), coalesce('1' || status, '0'), root nulls last) = 1
               on conflict (entry_id) do update
               set seq = excluded.seq, parent_id = excluded.parent_id, status = excluded.status, root = excluded.root
               where row(case when excluded.seq = -(2**62)::bigint then (2**62)::bigint else excluded.seq end, coalesce('1' || excluded.parent_id, '0'), coalesce('1' || excluded.status, '0'), excluded.root is null)
                   < row(case when entries.seq = -(2**62)::bigint then (2**62)::bigint else entries.seq end, coalesce('1' || entries.parent_id, '0'), coalesce('1' || entries.status, '0'), entries.root is null)"""
        )
        con.unregister("feed")
    if some:
        yield from con.sql("select 0::int as kind, entry_id, seq, parent_id, status, root, bucket from entries order by bucket, entry_id").to_arrow_reader(8192)
        # Retracted ones stay as tombstones.
        yield from con.sql(
            """select 1::int as kind, entry_id, seq, null::varchar as parent_id, status, root, bucket from entries where root is not null
               qualify row_number() over (partition by bucket, root order by seq desc, encode(entry_id) desc) = 1 order by bucket, root"""
        ).to_arrow_reader(8192)
    con.close()


def state_table(spark: SparkSession, root: str | None = None) -> SnapshotTable:
    """The table of a feed, at a path of its own unless one is given."""
    return SnapshotTable(spark, root or scratch_path(spark, "state"), T.StructType.fromDDL(STATE), "bucket")


def apply_feed(feed: DataFrame, *, root: str | None = None, table: SnapshotTable | None = None, buckets: int | None = None, rows_per_bucket: int = 200_000) -> SnapshotTable:
    """Apply one batch of ``(entry_id, ts, parent_id, status)`` to the table and publish the new state.

    * An entry id counts once, at its earliest ts over all batches; repeats
      change nothing, so a batch may be sent again.
    * The entry of an action with the latest ts speaks for it (equal ts: the
      greatest entry id, by bytes); a null ts comes before every other, but a
      row of the entry with a ts replaces it.
    * Batches may come in any order, parents after their amendments: the state
      is that of all rows together.
    * Retracted actions stay in the table as tombstones; see :func:`standing`.
    * Rows without an entry id take no part; other columns are ignored.

    The number of buckets is fixed by the first batch: ``buckets``, or one for
    ``rows_per_bucket`` of its rows; a table that outgrows it fourfold is
    written again with more. Otherwise only buckets that get a new row, or in
    which an entry finds its original, are rewritten.
    """
    spark = feed.sparkSession
    table = table or state_table(spark, root)
    batch = distinct_entries(feed.select("entry_id", F.col("ts").cast("long").alias("ts"), "parent_id", "status"))
    n_buckets = table.meta().get("buckets")
    if n_buckets is None:
        batch = cut(batch)
        n_buckets = buckets or max(input_cores(spark), -(-batch.count() // rows_per_bucket))
    bucket = F.pmod(F.xxhash64("entry_id"), F.lit(int(n_buckets)))
    # A null ts loses against any ts of the same entry, but comes before all others among entries.
    rows = batch.select("entry_id", F.col("ts").alias("seq"), "parent_id", "status").withColumn("bucket", bucket)
    if not table.parts():
        return _rebuild(table, rows, int(n_buckets))
    touched = {r[0] for r in rows.select("bucket").distinct().collect()}  # at most the number of buckets
    stored = table.read().filter("kind = 0")
    old = table.read(touched).filter("kind = 0").select("entry_id", F.struct(F.when(F.col("seq") == _NO_TIME, F.lit(2**62)).otherwise(F.col("seq")).alias("seq"), "parent_id", "status").alias("_old"))
    rows = cut(rows.join(old, "entry_id", "left").filter(F.col("_old").isNull() | (F.struct(F.coalesce("seq", F.lit(2**62)).alias("seq"), "parent_id", "status") < F.col("_old"))))
    total = table.meta()["rows"] + rows.filter("_old is null").count()
    moved = F.col("_old").isNotNull() & ~F.col("parent_id").eqNullSafe(F.col("_old.parent_id"))
    if rows.isEmpty():
        return table
    if total > 4 * rows_per_bucket * n_buckets or not rows.filter(moved).isEmpty():
        # The buckets are full, or an entry turns out to have another parent and everything behind it may lead elsewhere.
        every = stored.select("entry_id", F.when(F.col("seq") > _NO_TIME, F.col("seq")).alias("ts"), "parent_id", "status").unionByName(rows.select("entry_id", F.col("seq").alias("ts"), "parent_id", "status"))
        n_buckets = max(int(n_buckets), -(-total // rows_per_bucket))
        return _rebuild(table, distinct_entries(every).withColumnRenamed("ts", "seq").withColumn("bucket", F.pmod(F.xxhash64("entry_id"), F.lit(n_buckets))), n_buckets)
    waiting = stored.filter("root is null").select("entry_id", "seq", "parent_id", "status", "bucket").join(rows.select("entry_id"), "entry_id", "left_anti")
    nodes = cut(rows.select("entry_id", F.coalesce("seq", F.lit(_NO_TIME)).alias("seq"), "parent_id", "status", "bucket", F.lit(True).alias("new")).unionByName(waiting.withColumn("new", F.lit(False))))
    # Originals of stored parents, looked up in the buckets the parents may lie in.
    parents = nodes.filter("parent_id is not null").select(F.col("parent_id").alias("entry_id")).distinct()
    near = {r[0] for r in parents.select(bucket).distinct().collect()}
    known = table.read(near).filter("kind = 0 and root is not null").select("entry_id", "root").join(parents, "entry_id", "left_semi")
    changed = materialize(_led(nodes, known).filter("new or root is not null").drop("new"), "changed")
    affected = {r[0] for r in changed.select("bucket").distinct().collect()}
    both = table.read(affected).filter("kind = 0").drop("kind")
    both = both.unionByName(changed.select(*both.columns))
    table.replace(both.repartitionById(int(n_buckets), F.col("bucket").cast("int")).mapInArrow(_upsert_bucket, STATE), affected, meta={"rows": total})
    discard(changed)
    return table


def _led(nodes: DataFrame, known: DataFrame | None) -> DataFrame:
    """Nodes with their roots, null for those that lead to none."""
    roots = resolve_roots(nodes.withColumnRenamed("seq", "ts"), known).select("entry_id", "root")
    return nodes.join(roots, "entry_id", "left")


def _rebuild(table: SnapshotTable, rows: DataFrame, n_buckets: int) -> SnapshotTable:
    nodes = cut(rows.select("entry_id", F.coalesce("seq", F.lit(_NO_TIME)).alias("seq"), "parent_id", "status", "bucket"))
    every = cut(_led(nodes, None)).select("entry_id", "seq", "parent_id", "status", "root", "bucket")
    table.replace(every.repartitionById(n_buckets, F.col("bucket").cast("int")).mapInArrow(_upsert_bucket, STATE), meta={"buckets": n_buckets, "rows": every.count()})
    return table


def standing(table: SnapshotTable, retracted: str = "retracted") -> DataFrame:
    """``(entry_id, last_entry_id)`` of the actions that stand, without tombstones."""
    last = table.read().filter("kind = 1").groupBy("root").agg(F.max(F.struct("seq", "entry_id", "status")).alias("r"))
    return last.filter(~F.col("r.status").eqNullSafe(F.lit(retracted))).select(F.col("root").alias("entry_id"), F.col("r.entry_id").alias("last_entry_id"))
