"""Distributed global rank: a number for every row of one total order.

Rows are range-partitioned by the order, sorted inside their partitions and
written by checkpoint(). The rows of each partition are counted (one row per
partition, the only table that reaches the driver), the counts before a
partition are its offset, and a row's rank is offset + place in its partition.
There is no window without a partition key and no task sees more than its
range.

``group_rank`` numbers rows inside groups the same way: a group that spans
partitions goes on in the next one, so a row's rank is its place among the
group's rows in its partition, plus the group's rows in the partitions before.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.session import ensure_checkpoint_dir

# monotonically_increasing_id() holds the row's place in its partition in its lower 33 bits.
_PLACE = (1 << 33) - 1


def ranged(df: DataFrame, *order: Column | str) -> DataFrame:
    """Rows of ``df`` range-partitioned and sorted by ``order``, as a checkpointed table."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.repartitionByRange(*order).sortWithinPartitions(*order).checkpoint()


def global_rank(df: DataFrame, order: list[Column | str], name: str = "rank") -> DataFrame:
    """``df`` with ``name`` (bigint, from 1): the row's place in ``order``.

    ``order`` should end in a unique column; rows equal in all of ``order``
    get consecutive ranks in any order (and cannot be split over tasks).
    """
    spark = df.sparkSession
    rows = ranged(df, *order)
    place = rows.withColumn(name, F.monotonically_increasing_id())
    counts = {r.pid: r.n for r in rows.groupBy(F.spark_partition_id().alias("pid"))
              .agg(F.count(F.lit(1)).alias("n")).collect()}
    pids = sorted(counts)
    before = list(accumulate((counts[p] for p in pids), initial=0))[:-1]
    # One row per partition that has rows: bounded by the number of partitions.
    offsets = spark.createDataFrame(list(zip(pids, before)) or [(0, 0)], "_pid int, _before long")
    return (place.withColumn("_pid", F.shiftright(F.col(name), 33).cast("int"))
            .join(F.broadcast(offsets), "_pid")
            .withColumn(name, F.col("_before") + F.col(name).bitwiseAND(F.lit(_PLACE)) + 1)
            .drop("_pid", "_before"))


def group_rank(df: DataFrame, group: list[str], order: list[Column | str], name: str = "rank") -> DataFrame:
    """``df`` with ``name`` (bigint, from 1): the row's place in ``order`` inside
    its group (columns ``group``; NULLs are a group). One group may hold any part of
    the rows: the window's key is the group's part of one range."""
    spark = df.sparkSession
    rows = ranged(df, *group, *order).withColumns({
        "_pid": F.spark_partition_id(),
        "_place": F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE))})
    parts = rows.groupBy("_pid", *group).agg(F.min("_place").alias("first"), F.count(F.lit(1)).alias("n"))
    part = F.struct(F.struct(*group).alias("g"), "n")
    ends = (parts.groupBy("_pid").agg(F.min_by(part, "first").alias("low"), F.max_by(part, "first").alias("high"))
            .orderBy("_pid").collect())
    carry, last, seen = [], None, 0
    for e in ends:  # one row per partition
        goes_on = last is not None and e.low.g == last
        carry.append((e["_pid"], seen if goes_on else 0))
        last, seen = e.high.g, e.high.n + (seen if goes_on and e.low.g == e.high.g else 0)
    offsets = spark.createDataFrame(carry or [(0, 0)], "_pid int, _before long")
    w = Window.partitionBy("_pid", *group)
    return (rows.join(F.broadcast(offsets), "_pid")
            .withColumn(name, F.row_number().over(w.orderBy("_place"))
                        + F.when(F.min("_place").over(w) == 0, F.col("_before")).otherwise(0))
            .drop("_pid", "_place", "_before"))
