"""Positions and running sums in an order, without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def running(rows: DataFrame, order: Sequence[Column], weight: Column, name: str) -> DataFrame:
    """rows with `name`, the sum of weight (whole numbers, not null) over the rows that come before in the order (long).

    Ranges of the order are summed each on its own and start after the sums of the ranges before. The ranges are written
    once, so that a range is the same for its sum and for its rows. Rows that tie in the whole order stand in any order.
    Broadcast is one row per range, as many as shuffle partitions at most."""
    ranges = written(rows.withColumn("_weight", weight.cast("long")).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = ranges.groupBy("_range").agg(F.sum("_weight").alias("_sum"))
    before = sums.select(F.col("_range").alias("_at"), (F.sum("_sum").over(Window.orderBy("_range")) - F.col("_sum")).alias("_before"))
    upto = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = ranges.withColumn("_own", F.sum("_weight").over(upto) - F.col("_weight"))
    summed = own.join(F.broadcast(before), F.col("_range") == F.col("_at"))
    return summed.select(*rows.columns, (F.col("_before") + F.col("_own")).cast("long").alias(name))


def positions(rows: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """rows with `name`, their 0-based place in the order (long): running() of ones."""
    return running(rows, order, F.lit(1), name)
