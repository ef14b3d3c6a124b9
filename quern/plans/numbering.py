"""Consecutive numbers along a global order without putting all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.plans.lineage import cut_lineage


def numbered(df: DataFrame, *order: Column, name: str = "number") -> DataFrame:
    """Adds ``name``: 0, 1, ... along ``order``.

    Rows are range-partitioned and sorted; the partitions' row counts (one row a partition) are prefix-summed and
    broadcast. The sorted rows are written once, so every read sees the same partitions.
    """
    placed = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_before")
