"""Numbers and running maxima along an order within groups of any size.

A window over a group puts it into one task.  Here the rows are dealt by ranges of group and order, so that a large
group lies in several partitions, one after the other; only one row for each group and partition is put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import stored


def _before(group: str):
    return Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)


def _with(rows: DataFrame, each: DataFrame, group: str, value: str) -> DataFrame:
    """rows with a value of their partition and group, which may be null."""
    side = each.select(F.col("part").alias("_part"), F.col(group).alias("_group"), value)
    return rows.join(side, (F.col("part") == F.col("_part")) & F.col(group).eqNullSafe(F.col("_group"))).drop("_part", "_group")


def numbered(df: DataFrame, group: str, *order: Column) -> DataFrame:
    """df with k, each row's number in its group from 0, and with part and at, its partition and its place in there."""
    keys = {f"_key{n}": c for n, c in enumerate(order)}
    by = [group, *keys, "_spread"]  # the last one splits rows that are equal in all others
    rows = df.withColumns(keys).withColumn("_spread", F.xxhash64(F.monotonically_increasing_id()))
    rows = rows.repartitionByRange(*by).sortWithinPartitions(*by).drop(*by[1:]).withColumn("at", F.monotonically_increasing_id())
    rows = stored(rows.withColumn("part", F.shiftright("at", 33)))
    each = rows.groupBy("part", group).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    each = each.withColumn("shift", F.coalesce(F.sum("n").over(_before(group)), F.lit(0)) - F.col("first"))
    return _with(rows, each, group, "shift").withColumn("k", F.col("at") + F.col("shift")).drop("shift")


def running_max(rows: DataFrame, group: str, value: Column) -> DataFrame:
    """What numbered() gives, with most: the largest value of the group up to the row."""
    rows = rows.withColumn("_value", value)
    each = rows.groupBy("part", group).agg(F.max("_value").alias("_most"))
    each = each.withColumn("ahead", F.max("_most").over(_before(group)))
    own = Window.partitionBy("part", group).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return _with(rows, each, group, "ahead").withColumn("most", F.greatest("ahead", F.max("_value").over(own))).drop("ahead", "_value")
