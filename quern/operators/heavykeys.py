"""Per-key results where a handful of keys holds most rows.

All measures are algebraic, so every task combines its rows into a bounded hash table of mergeable key states (which
Spark spills when it is full) and only those compact partial states are shuffled: a key holding half of all rows costs
one state per task, like any other key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_profile(df: DataFrame, key: str, measures: dict[str, Column] | None = None) -> DataFrame:
    """One row per key (null is a key of its own): ``category_id, n_rows`` and the given algebraic ``measures``.

    An empty table gives no rows. Extra columns of ``df`` are ignored and may have any names.
    """
    aggs = [F.count(F.lit(1)).alias("n_rows"), *(c.alias(n) for n, c in (measures or {}).items())]
    return df.groupBy(F.col(key).alias("category_id")).agg(*aggs)


def distinct_per_key(df: DataFrame, key: str, value: str) -> DataFrame:
    """Exact number of distinct non-null ``value`` per key, in two algebraic steps: no task holds a key's values.

    The first step is keyed by (key, value), so a hot key is spread over all tasks; the second combines map-side.
    """
    pairs = df.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("category_id"), F.col(value).alias("_v")).agg(F.lit(1).alias("_one"))
    return pairs.groupBy("category_id").agg(F.sum("_one").cast("long").alias("n_distinct"))


def heavy_keys(df: DataFrame, key: str, share: float = 0.05) -> DataFrame:
    """Keys holding at least ``share`` of all rows (rows with a null key count in the total but null is no key).

    Columns ``category_id, n_rows, n_total``; at most ``1 / share`` rows. An empty table gives no rows.
    """
    counts = key_profile(df, key)
    total = counts.agg(F.sum("n_rows").alias("n_total"))
    return (
        counts.where(F.col("category_id").isNotNull())
        .join(F.broadcast(total), F.col("n_rows") >= F.col("n_total") * F.lit(share))
        .select("category_id", "n_rows", "n_total")
    )
