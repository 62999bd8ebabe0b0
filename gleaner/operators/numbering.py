"""Row numbers within a key that don't put a key into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import staged


def numbered(df: DataFrame, key: str, order: list[str | Column], name: str) -> DataFrame:
    """df with its rows numbered from 1 within each key, by order.

    Rows are sorted over ranges of (key, order); what a range holds of a key is counted, and the counts of the ranges before
    it are its offset.
    """
    rows = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("_at", F.monotonically_increasing_id())
    rows = staged(rows, "numbered").withColumn("_range", F.shiftright("_at", 33))
    held = rows.groupBy(key, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(key, "_range", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    nth = F.col("_at") - F.col("_first") + F.col("_before") + 1
    return rows.join(held, [key, "_range"]).withColumn(name, nth).drop("_at", "_range", "_first", "_before")
