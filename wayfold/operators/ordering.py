"""Global numbering and running sums without one task that sorts everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.session import Scratch


def running(df: DataFrame, keys: list[str], amount: Column, name: str, scratch: Scratch) -> DataFrame:
    """Add ``name``: the sum of ``amount`` over all rows before this one in order of ``keys``.

    Keys must be unique. Rows are range-partitioned; only one total per partition is gathered.
    """
    parts = scratch.keep(df.withColumn("_amount", amount.cast("bigint")).repartitionByRange(*keys).withColumn("_pid", F.spark_partition_id()))
    totals = parts.groupBy("_pid").agg(F.sum("_amount").alias("_total"))
    starts = totals.select("_pid", (F.sum("_total").over(Window.orderBy("_pid")) - F.col("_total")).alias("_start"))
    inside = F.sum("_amount").over(Window.partitionBy("_pid").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_amount")
    return parts.withColumn("_inside", inside).join(F.broadcast(starts), "_pid").withColumn(name, F.col("_start") + F.col("_inside")).drop("_pid", "_amount", "_inside", "_start")
