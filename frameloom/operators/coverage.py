"""Continuous periods and gaps of overlapping intervals per entity.

Intervals are sorted by start within an entity, each start is compared with
the running maximum of the previous ends, islands are labelled by the
cumulative sum of breaks and aggregated to periods, and gaps are what lies
between.

An entity may own a third of all rows, so no step sorts a whole entity in one
task. Rows are cut into (entity, time bucket of the start) groups. Two tables
of one row per group carry what a group must know of the others: the running
maximum end before it, and the first break after it. Their size follows the
time range, not the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

US = 1_000_000


def merge_intervals(
    df: DataFrame,
    keys: list[str],
    start: str = "start_us",
    end: str = "end_us",
    *,
    join_within_us: int = 2 * US,
    max_gap_us: int | None = 6 * 3600 * US,
    bucket_us: int = 3600 * US,
) -> DataFrame:
    """Rows ``(*keys, kind, start_us, end_us)`` of kind ``period`` and ``gap``.

    * An interval belongs to the current period if it starts at most
      ``join_within_us`` after the latest end so far.
    * A gap reaches from the end of a period to the start of the next one of
      the same entity and is listed if at most ``max_gap_us`` long (``None``:
      always).
    * Rows with a null key or bound, or an end not after the start, take no
      part. Repeated rows and ties change nothing. An empty table gives an
      empty result. Other columns are ignored, whatever their names.
    """
    rows = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e"))
    ks = [f"k{i}" for i in range(len(keys))]
    ok = F.col("e") > F.col("s")
    for k in ks:
        ok = ok & F.col(k).isNotNull()
    rows = rows.filter(ok).withColumn("b", F.floor(F.col("s") / F.lit(bucket_us)).cast("long"))

    # Running maximum end before each (entity, bucket); one row per group.
    per_entity = Window.partitionBy(*ks).orderBy("b")
    carry = (
        rows.groupBy(*ks, "b")
        .agg(F.max("e").alias("m"))
        .select(*ks, "b", F.max("m").over(per_entity.rowsBetween(Window.unboundedPreceding, -1)).alias("carry"), F.max("m").over(Window.partitionBy(*ks)).alias("last_end"))
    )

    group = Window.partitionBy(*ks, "b").orderBy("s", "e")
    breaks = (
        rows.join(carry, [*ks, "b"])
        .withColumn("p", F.greatest("carry", F.max("e").over(group.rowsBetween(Window.unboundedPreceding, -1))))
        .filter(F.col("p").isNull() | (F.col("s") > F.col("p") + F.lit(join_within_us)))
        .select(*ks, "b", "s", "p", "last_end")
    )

    # The end of a period is the running maximum at the next break.
    following = Window.partitionBy(*ks).orderBy("b").rowsBetween(1, Window.unboundedFollowing)
    nxt = breaks.groupBy(*ks, "b").agg(F.min_by("p", "s").alias("first_p")).select(*ks, "b", F.first("first_p", ignorenulls=True).over(following).alias("next_p"))
    in_group = Window.partitionBy(*ks, "b").orderBy("s")
    out = (
        breaks.join(nxt, [*ks, "b"])
        .withColumn("period_end", F.coalesce(F.lead("p").over(in_group), "next_p", "last_end"))
        .select(
            *ks,
            F.explode(
                F.array(
                    F.struct(F.lit("period").alias("kind"), F.col("s").alias("a"), F.col("period_end").alias("z")),
                    F.struct(F.lit("gap").alias("kind"), F.col("p").alias("a"), F.col("s").alias("z")),
                )
            ).alias("x"),
        )
        .select(*ks, "x.*")
        .filter(F.col("a").isNotNull())
    )
    if max_gap_us is not None:
        out = out.filter((F.col("kind") == "period") | (F.col("z") - F.col("a") <= max_gap_us))
    return out.select(*[F.col(c).alias(k) for c, k in zip(ks, keys)], "kind", F.col("a").alias("start_us"), F.col("z").alias("end_us"))
