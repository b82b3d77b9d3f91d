"""Running totals in a total order, in two levels: within ranges of the order, then over the ranges.

Rows are dealt by range of the order, so each task holds neighbours. The ranges' totals are one row for
each task; their running totals are added to what each task summed by itself. No window spans the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lustrate.scratch import Scratch

#: Rows of a range at most, about; it bounds what a window sorts at a time.
RANGE_ROWS = 1 << 20


def running_totals(rows: DataFrame, order: list[str], value: str, scratch: Scratch, out: str = "running", ranges: int | None = None) -> DataFrame:
    """``rows`` with the sum of ``value`` over each row and all before it, by ``order`` (which should be
    unique: rows that are equal in it have no defined order among them). Null values add nothing; an
    empty table gives no rows."""
    spark = rows.sparkSession
    if ranges is None:
        ranges = max(spark.sparkContext.defaultParallelism, -(-rows.count() // RANGE_ROWS))
    held = scratch.save(rows.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = held.groupBy("_range").agg(F.sum(value).alias("total")).orderBy("_range").collect()  # a row for each range
    before, sums = 0, []
    for row in totals:
        sums.append((row["_range"], before))
        before += row["total"] or 0
    offsets = spark.createDataFrame(sums, f"_range int, _before {held.schema[value].dataType.simpleString()}")
    within = F.sum(value).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return held.withColumn(out, within).join(F.broadcast(offsets), "_range").withColumn(out, F.coalesce(out, F.lit(0)) + F.col("_before")).drop("_range", "_before")


def within_budget(rows: DataFrame, order: list[str], value: str, budget: int, scratch: Scratch) -> DataFrame:
    """``rows`` with ``running`` and whether the running total has passed ``budget``."""
    return running_totals(rows, order, value, scratch).withColumn("over_limit", F.col("running") > budget)


def batches(rows: DataFrame, order: list[str], value: str, batch: int, scratch: Scratch) -> DataFrame:
    """``rows`` with a ``batch`` number: neighbours in the order, about ``batch`` of ``value`` each."""
    total = running_totals(rows, order, value, scratch)
    return total.withColumn("batch", F.floor((F.col("running") - F.coalesce(value, F.lit(0))) / batch).cast("int")).drop("running")
