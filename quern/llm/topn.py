"""The N best items of every group by one global sort.

Rows are range-partitioned and sorted by (group, score, identifier), so a group of any size spans as many partitions as
it needs. Each partition keeps, in one pass, its first N rows of every group with their local position; the per-partition
group counts are then prefix-summed over the partitions, which turns local positions into exact ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_scores(df: DataFrame, group: str, item: str, score: str) -> DataFrame:
    """One row per (group, item) with its highest score; rows with a null id or a null or NaN score don't count."""
    value = F.col(score).cast("double")
    rows = df.select(F.col(group).alias("g"), F.col(item).alias("i"), (value + 0.0).alias("s"))
    rows = rows.where(F.col("g").isNotNull() & F.col("i").isNotNull() & F.col("s").isNotNull() & ~F.isnan("s"))
    return rows.groupBy("g", "i").agg(F.max("s").alias("s"))


def _local_positions(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column(0)
            size = len(g)
            starts = np.ones(size, bool)
            if size > 1:
                starts[1:] = pc.not_equal(g.slice(1), g.slice(0, size - 1)).to_numpy(zero_copy_only=False)
            carried = last is not None and g[0].as_py() == last
            starts[0] = not carried
            at = np.arange(size)
            begin = np.maximum.accumulate(np.where(starts, at, -1))
            position = np.where(begin >= 0, at - begin, at + seen) + 1
            last, seen = g[size - 1].as_py(), int(position[-1])
            keep = np.flatnonzero(position <= n)
            if len(keep):
                out = batch.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(position[keep].astype("int64"))], names=["g", "i", "s", "pid", "local"])

    return run


def top_n(df: DataFrame, group: str, item: str, score: str, n: int) -> DataFrame:
    """``<group>, <item>, <score>, position`` of the ``n`` best items of each group, fewer where it has fewer.

    An item counts once, with its highest score; equal scores go to the smaller identifier. Rows with a null id or a null
    or NaN score don't count; an empty table gives no rows.
    """
    best = best_scores(df, group, item, score)
    ordered = best.repartitionByRange(F.col("g"), F.col("s").desc(), F.col("i")).sortWithinPartitions(F.col("g"), F.col("s").desc(), F.col("i"))
    ordered = ordered.withColumn("pid", F.spark_partition_id())
    kept = ordered.mapInArrow(_local_positions(n), "g string, i string, s double, pid int, local long")
    # A partition's count of a group, capped at n, is the local position of its last kept row.
    whole = Window.partitionBy("g", "pid")
    before = Window.partitionBy("g").orderBy("pid").rangeBetween(Window.unboundedPreceding, -1)
    counted = kept.withColumn("count", F.when(F.col("local") == F.max("local").over(whole), F.col("local")).otherwise(0))
    placed = counted.withColumn("position", F.coalesce(F.sum("count").over(before), F.lit(0)) + F.col("local")).where(F.col("position") <= n)
    return placed.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), "position")
