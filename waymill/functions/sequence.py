"""Dense numbers and running sums over a global order, without one task that sees all rows.

Rows are grouped into coarse ranges of their leading key. The ranges' sums, far fewer than the
rows, are added up in order; inside a range a window does the rest, in as many tasks as there
are ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(df: DataFrame, coarse: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """df with name: the sum of value over all rows before, by (coarse, order); coarse follows order."""
    ranged = df.withColumn("_range", coarse).withColumn("_value", value)
    totals = ranged.groupBy("_range").agg(F.sum("_value").alias("_total"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    return summed.join(offsets, "_range").withColumn(name, F.col("_offset") + F.col("_inside")).drop("_range", "_value", "_inside", "_offset")


def dense_number(df: DataFrame, coarse: Column, order: list[str], name: str) -> DataFrame:
    """df with name: its row number from 0 by (coarse, order)."""
    return running_sum(df, coarse, order, F.lit(1).cast("long"), name)
