"""Positions of rows in a global order, without a task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.operators.lineage import cut


def running(df: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``df`` with running sums of whole numbers, the row itself included, in the order of ``order``; ties in ``order`` go in any order.

    Rows are dealt by ranges of all of ``order``, so equal first columns are parted by the next ones; each range adds up for
    itself, and what comes before a range is a running sum over the ranges, of which there are as many as shuffle partitions.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id())
    placed = cut(placed.withColumn("_part", F.shiftright("_row", 33)))
    own = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy("_part").agg(*[F.sum(x.cast("long")).alias(f"_{n}") for n, x in sums.items()])
    ranges = ranges.select("_part", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums])
    # One row for each shuffle partition.
    both = placed.withColumns({n: F.sum(x.cast("long")).over(own) for n, x in sums.items()}).join(F.broadcast(ranges), "_part")
    return both.withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).drop("_part", "_row", *[f"_{n}" for n in sums])


def reached(steps: DataFrame, start: int) -> DataFrame:
    """(i) of all numbers that ``start`` leads to by (i, next), itself included; next is larger than i, or not among the i.

    By doubling: each round joins steps twice as long, so there are as many rounds as the logarithm of the longest way.
    """
    found = cut(steps.where(F.col("i") == start).select("i"))
    jumps = cut(steps.select("i", "next"))
    while not jumps.isEmpty():
        further = found.join(jumps, "i").select(F.col("next").alias("i")).join(steps.select("i"), "i", "left_semi")
        found = cut(found.union(further))
        twice = jumps.select("i", F.col("next").alias("_at")).join(jumps.select(F.col("i").alias("_at"), "next"), "_at")
        jumps = cut(twice.select("i", "next"))
    return found


def newest_before(asked: DataFrame, rows: DataFrame, within_ms: int, most: int) -> DataFrame:
    """(window_id, rank, id): for each (window_id, at) the ``most`` newest (id, created_at) of the ``within_ms`` up to then, newest first, ties by id.

    Every row knows its position in time and every window how many rows are before it, so a window joins the ``most`` positions
    that it needs, however many rows one moment has.
    """
    own = rows.select(F.col("created_at").alias("t"), F.lit(0).alias("kind"), F.col("id").cast("string").alias("key"))
    every = own.union(asked.select(F.col("at").alias("t"), F.lit(1).alias("kind"), F.col("window_id").cast("string").alias("key")))
    placed = cut(running(every, ["t", "kind", "key"], {"position": F.col("kind") == 0}))
    held = placed.where("kind = 0").select("position", F.col("key").alias("id"), F.col("t").alias("created_at"))
    first = F.greatest(F.col("position") - (most - 1), F.lit(1))
    wants = placed.where("kind = 1 and position > 0").select(F.col("key").alias("window_id"), F.col("t").alias("at"), F.col("position").alias("last"), F.explode(F.sequence(first, F.col("position"))).alias("position"))
    found = wants.join(held, "position").where(F.col("created_at") >= F.col("at") - within_ms)
    return found.select("window_id", (F.col("last") - F.col("position") + 1).cast("int").alias("rank"), "id")
