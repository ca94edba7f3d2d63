"""The place of every row in one order of a whole table, without one sorted partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sidematch.session import materialize

# Row numbers of one partition take this many bits of a row's id.
ROW_BITS = 33


def global_rank(df: DataFrame, keys: list[str | Column], name: str = "rank") -> DataFrame:
    """``df`` with ``name``, the 0-based place of each row in the order of ``keys``.

    Spark cuts the key range by a sample, so equal work goes to every task and a value
    with a third of all rows is split as soon as a later key differs; the rows are shuffled
    once, sorted where they are and stored.  A row's place is its number in its range,
    after the sizes of the ranges before - one row per range.  Rows equal in all ``keys``
    take their places in any order.
    """
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    stored = materialize(ranged.withColumn("_id", F.monotonically_increasing_id()))
    stored = stored.withColumn("_range", F.shiftright("_id", ROW_BITS))
    sizes = stored.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.col("_id").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    # as many rows as there are ranges, that is shuffle partitions
    return stored.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + within).drop(
        "_id", "_range", "_start")


def value_places(df: DataFrame, value: str, name: str = "place") -> DataFrame:
    """``df`` with ``name``, the 1-based place of ``value`` among the different values of
    the whole table.

    Values are made different before they are ranked, so a value that a third of all rows
    have is one row there.
    """
    values = global_rank(df.select(value).distinct(), [value], "_rank")
    placed = values.select(F.col(value).alias("_value"), (F.col("_rank") + 1).alias(name))
    return df.join(placed, F.col(value).eqNullSafe(F.col("_value"))).drop("_value")
