"""Weighted reciprocal rank fusion over long frames of scored pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.plans.ranks import average_ranks, running_sums
from quern.plans.skew import HOT_SHARE, join_weighted

#: A query's rows are ranked in one task up to this number (or a thousandth of all rows), and by a global sort beyond.
ONE_TASK = 200_000


def average_rank(partition: str, score: str) -> Column:
    """Rank 1 for the highest score; equal scores share the mean of their ranks. A window over one partition."""
    w = Window.partitionBy(partition).orderBy(F.col(score).desc())
    return F.rank().over(w) + (F.count(F.lit(1)).over(w.rangeBetween(Window.currentRow, Window.currentRow)) - 1) / 2.0


def with_rank_terms(df: DataFrame, partition: str, item: str, scores: list[str]) -> DataFrame:
    """Adds ``rank_<score>`` to rows unique by ``partition`` and ``item``; null where the signal is constant for the
    partition, as it then says nothing. Scores are compared as they are stored (float); null scores aren't allowed.

    Partitions that fit a task are ranked by windows that share one exchange. The at most 1000 larger ones are ranked by
    counts of values along a global sort, so that none of them is held by one task.
    """
    counts = df.groupBy(partition).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    hot = counts.where(F.col("_n") > max(ONE_TASK, int(total * HOT_SHARE))).select(partition)
    whole = Window.partitionBy(partition)
    windows = lambda rows: rows.withColumns({f"rank_{s}": F.when(F.min(s).over(whole) != F.max(s).over(whole), average_rank(partition, s)) for s in scores})
    keys = [r[0] for r in hot.collect()]
    if not keys:
        return windows(df)
    listed = F.broadcast(df.sparkSession.createDataFrame([(k,) for k in keys], df.select(partition).schema))
    return windows(df.join(listed, partition, "left_anti")).unionByName(_ranked_by_counts(df.join(listed, partition, "left_semi"), partition, item, scores))


def _ranked_by_counts(df: DataFrame, partition: str, item: str, scores: list[str]) -> DataFrame:
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("signal"), F.col(s).alias("value")) for k, s in enumerate(scores)))).alias("x")
    long = df.select(F.col(partition).alias("p"), F.col(item).alias("i"), each).select("p", "i", "x.signal", "x.value")
    ranks = average_ranks(long, ["p", "signal"], "value").select("p", "signal", "value", "n", F.when(~F.col("alone"), F.col("rank")).alias("rank"))
    ranked = join_weighted(long, ranks, ["p", "signal", "value"], "n", df.count() * len(scores))
    wide = ranked.groupBy("p", "i").agg(*(F.max(F.when(F.col("signal") == k, F.col("rank"))).alias(f"rank_{s}") for k, s in enumerate(scores)))
    return df.join(wide.withColumnsRenamed({"p": partition, "i": item}), [partition, item])


def fused_score(scores: list[str], weights: list[float], k: int = 60) -> Column:
    """Sum of weight / (k + rank) over ranked signals, in the given order; 0 if all are constant or without weight."""
    if not scores or len(scores) != len(weights):
        raise ValueError("scores and weights must be equally many, and at least one")
    total = F.lit(0.0)
    for s, w in zip(scores, weights):
        if w:
            total = total + F.coalesce(F.lit(float(w)) / (F.lit(k) + F.col(f"rank_{s}")), F.lit(0.0))
    return total


def top_by(df: DataFrame, partition: str, score: str, item: str, k: int | None, name: str = "rrf_rank") -> DataFrame:
    """The ``k`` best rows of each partition (all if None), numbered from 1; equal scores go to the smaller item.

    With ``k``, every task keeps only its own ``k`` best rows of a partition before they are shuffled; without, rows are
    numbered along a global sort. Neither holds a partition in one task.
    """
    if k is None:
        placed = running_sums(df.withColumn("_one", F.lit(1).cast("long")), [partition], [F.col(score).desc(), F.col(item)], "_one", name)
        return placed.withColumn(name, F.col(name) + 1).drop("_one", "alone")
    w = Window.partitionBy(partition).orderBy(F.col(score).desc(), F.col(item))
    return df.withColumn(name, F.row_number().over(w).cast("long")).where(F.col(name) <= k)
