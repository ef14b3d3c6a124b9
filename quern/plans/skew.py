"""Joining rows whose key may be hot to a table with one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key counts as hot from this share of all rows on, so there are at most ``1 / HOT_SHARE`` hot keys at any size.
HOT_SHARE = 0.001


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` in a fixed number of partitions by ``keys``, for joins that yield far more than they read: adaptive
    coalescing would go by the small input and leave the work to a few tasks."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def join_weighted(rows: DataFrame, table: DataFrame, key: str | list[str], weight: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``table`` (one row per ``key``, ``weight`` = its number of rows in ``rows``).

    The at most 1000 hot keys are broadcast, so their rows never move; all others take a shuffle join whose largest
    key has under a thousandth of the rows.
    """
    keys = [key] if isinstance(key, str) else key
    bar = max(1, int(total * HOT_SHARE))
    hot = table.where(F.col(weight) > bar).drop(weight)
    cold = table.where(F.col(weight) <= bar).drop(weight)
    from_hot = rows.join(F.broadcast(hot), keys)
    from_cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return from_hot.unionByName(from_cold)


def attach_members(pairs: DataFrame, members: DataFrame, key: str, name: str, least_chunk: int = 2048) -> DataFrame:
    """``pairs`` joined with ``members`` (``key``, ``id``), the id as ``name``: one row per pair and member.

    A key with many members is cut into chunks of about a thousandth of all members, for which the pairs are repeated,
    so no task takes more than one chunk of a hot key. At most 1000 keys are that hot; their list is broadcast.
    """
    total = members.count()
    bar = max(least_chunk, int(total * HOT_SHARE))
    hot = members.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > bar)
    hot = F.broadcast(hot.select(key, F.ceil(F.col("_n") / bar).cast("int").alias("_chunks")))
    chunks = F.coalesce("_chunks", F.lit(1))
    left = pairs.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), chunks - 1))).drop("_chunks")
    right = members.select(key, F.col("id").alias(name)).join(hot, key, "left")
    right = right.withColumn("_salt", F.pmod(F.xxhash64(name), chunks).cast("int")).drop("_chunks")
    return left.join(right, [key, "_salt"]).drop("_salt")


def _chunked(df: DataFrame, key: str, chunk: int, name: str) -> DataFrame:
    """``key, <name>``: into how many chunks the rows of a hot key go. At most ``1 / HOT_SHARE`` keys are hot."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    bar = max(chunk, int(total * HOT_SHARE))
    return counts.where(F.col("_n") > bar).select(key, F.ceil(F.col("_n") / bar).cast("int").alias(name))


def salted_join(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str, chunk: int = 2048) -> DataFrame:
    """Inner join on ``key`` where both sides may have hot keys: each side's rows of a hot key are cut into chunks by its id,
    and every chunk meets every chunk of the other side in a place of its own. Both inputs are read twice."""
    a, b = F.broadcast(_chunked(left, key, chunk, "_ka")), F.broadcast(_chunked(right, key, chunk, "_kb"))
    n = lambda c: F.coalesce(F.col(c), F.lit(1))
    part = lambda c, k: F.pmod(F.xxhash64(c), n(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), n(k) - 1))
    left = left.join(a, key, "left").join(b, key, "left").withColumn("_sa", part(left_id, "_ka")).withColumn("_sb", every("_kb")).drop("_ka", "_kb")
    right = right.join(a, key, "left").join(b, key, "left").withColumn("_sb", part(right_id, "_kb")).withColumn("_sa", every("_ka")).drop("_ka", "_kb")
    return left.join(right, [key, "_sa", "_sb"]).drop("_sa", "_sb")


def self_pairs(df: DataFrame, key: str, value: str, chunk: int = 2048) -> DataFrame:
    """``key, <value>_a < <value>_b``: all pairs of distinct values of a key, for ``df`` (key, value) without repeats.

    A key with many values is cut into chunks; each two chunks meet in a place of their own. ``df`` is read twice.
    """
    hot = F.broadcast(_chunked(df, key, chunk, "_k"))
    n = F.coalesce("_k", F.lit(1))
    cut = df.select(key, value).join(hot, key, "left").withColumn("_c", F.pmod(F.xxhash64(value), n).cast("int"))
    cut = cut.withColumn("_other", F.explode(F.sequence(F.lit(0), n - 1)))
    cut = cut.select(key, F.least("_c", "_other").alias("_low"), F.greatest("_c", "_other").alias("_high"), "_c", value)
    side = lambda s: cut.select(key, "_low", "_high", F.col("_c").alias(f"_c_{s}"), F.col(value).alias(f"{value}_{s}"))
    met = side("a").join(side("b"), [key, "_low", "_high"]).where(F.col(f"{value}_a") < F.col(f"{value}_b"))
    # Two chunks' place holds pairs across only; a chunk's own pairs meet in its own place.
    return met.where((F.col("_low") == F.col("_high")) | (F.col("_c_a") != F.col("_c_b"))).select(key, f"{value}_a", f"{value}_b")
