"""Numbers in a total order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.shared import written


def numbered(df: DataFrame, order: list[Column | str], name: str = "number") -> DataFrame:
    """df with its rows' numbers, from 1 in an order that has no ties.

    Rows are dealt to ranges and sorted there; a row's number is its place in its range and
    the sizes of the ranges before, a row each. The ranges are a written table, so that
    places and sizes are of the same rows.
    """
    parts = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_id", 33)
    sizes = parts.groupBy(part.alias("_part")).count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    offsets = sizes.select("_part", before.alias("_before"))
    numbers = F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return parts.withColumn("_part", part).join(offsets, "_part").withColumn(name, numbers).drop("_id", "_part", "_before")
