"""Reading order, interval coverage and forward fill."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reading_order(items: DataFrame, tolerance: float) -> DataFrame:
    """Rows top to bottom (a new one where y grows by `tolerance` or more), left to right within."""
    down = Window.partitionBy("page").orderBy("y", "x", "id")
    opens = F.when(F.col("y") - F.lag("y").over(down) >= tolerance, 1).otherwise(0)
    rows = items.withColumn("_open", opens).withColumn("row", F.sum("_open").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("page").orderBy("row", "x", "y", "id"))).drop("_open")


def coverage(segments: DataFrame, key: str, low: str, high: str) -> DataFrame:
    """Length covered by each key's intervals; touching ones merge."""
    by = Window.partitionBy(key).orderBy(low, high)
    before = F.max(high).over(by.rowsBetween(Window.unboundedPreceding, -1))
    added = F.greatest(F.lit(0.0), F.col(high) - F.greatest(F.col(low), F.coalesce(before, F.col(low))))
    return segments.withColumn("_added", added).groupBy(key).agg(F.sum("_added").alias("covered"))


def forward_fill(rows: DataFrame, key: str, order: list[str], column: str, into: str) -> DataFrame:
    by = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(into, F.last(column, ignorenulls=True).over(by))
