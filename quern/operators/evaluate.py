"""Recall, coverage checks, signal ablation and threshold calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.config import SIGNALS, GeneratorConfig
from quern.functions.vectors import dot
from quern.operators.candidates import best_items

# The grid of thresholds.
THRESHOLDS = (0.74, 0.76, 0.78, 0.80, 0.82, 0.84, 0.86, 0.88, 0.90)
#: Ablation variants as weights in the order of the signals: all, each one left out, text coverage alone.
VARIANTS = {"all signals": (1.0,) * len(SIGNALS)}
VARIANTS |= {f"without {s}": tuple(float(t != s) for t in SIGNALS) for s in SIGNALS}
VARIANTS |= {"text_coverage only": tuple(float(t == "text_coverage") for t in SIGNALS)}


def recall_per_query(predictions: DataFrame, relevance: DataFrame, ks: list[int], rank: str = "rrf_rank") -> DataFrame:
    """``k, query_id, n_relevant, recall`` for every query of ``relevance`` (query_id, item_id): hits among the first k
    predictions / relevant items. Queries without predictions have 0; repeated predictions count once, at their best."""
    known = relevance.distinct()
    best = predictions.groupBy("query_id", "item_id").agg(F.min(rank).alias("r"))
    hits = known.join(best, ["query_id", "item_id"], "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"), *(F.sum((F.coalesce(F.col("r") <= k, F.lit(False))).cast("long")).alias(f"h{k}") for k in ks))
    long = hits.select("query_id", "n_relevant", F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("k"), F.col(f"h{k}").alias("h")) for k in ks))).alias("x"))
    return long.select("x.k", "query_id", "n_relevant", (F.col("x.h") / F.col("n_relevant")).alias("recall"))


def recall_at_k(predictions: DataFrame, relevance: DataFrame, ks: list[int], rank: str = "rrf_rank") -> DataFrame:
    """``k, recall_at_k``: the mean over queries, by k."""
    return recall_per_query(predictions, relevance, ks, rank).groupBy("k").agg(F.avg("recall").alias("recall_at_k")).orderBy("k")


def relevant_item_coverage(relevance: DataFrame, corpus: DataFrame) -> DataFrame:
    """Share of all (query, relevant item) pairs whose item is in the corpus; null if there are none."""
    have = corpus.select("item_id").distinct().withColumn("_in", F.lit(1.0))
    return relevance.distinct().join(have, "item_id", "left").agg(F.avg(F.coalesce("_in", F.lit(0.0))).alias("coverage"))


def shared_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys that both sides hold; no rows mean that they are disjoint."""
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_semi")


def ablation(queries: DataFrame, items: DataFrame, relevance: DataFrame, config: GeneratorConfig = GeneratorConfig(), ks: tuple[int, ...] = (50, 500), variants: dict = VARIANTS, semantic: DataFrame | None = None) -> DataFrame:
    """``variant, n_queries, recall_<k>...``: all variants are fused from the same ranks, in one run over the blocks.

    ``queries`` and ``items`` as from ``prepare_*``, written once; ``relevance`` is (query_id, item_id).
    """
    names = list(variants)
    best = best_items(queries, items, config, [list(variants[n]) for n in names], semantic)
    found = best.groupBy("variant", "query_id", "item_id").agg(F.min("rrf_rank").alias("r"))
    asked = relevance.select("query_id", "item_id").distinct().withColumn("variant", F.explode(F.array(*(F.lit(n).cast("long") for n in range(len(names))))))
    hits = asked.join(found, ["variant", "query_id", "item_id"], "left")
    per_query = hits.groupBy("variant", "query_id").agg(*(F.avg(F.coalesce(F.col("r") <= k, F.lit(False)).cast("double")).alias(f"recall_{k}") for k in ks))
    name = F.element_at(F.array(*(F.lit(n) for n in names)), F.col("variant").cast("int") + 1)
    return per_query.groupBy("variant").agg(F.count(F.lit(1)).alias("n_queries"), *(F.avg(f"recall_{k}").alias(f"recall_{k}") for k in ks)).withColumn("variant", name)


def threshold_calibration(positive: DataFrame, negative: DataFrame, a: str = "a", b: str = "b", thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """``threshold, true_positive_rate, false_positive_rate, separation`` over pairs of vectors; similarities are compared as float."""

    def rates(df: DataFrame, name: str) -> DataFrame:
        s = df.select(dot(F.col(a), F.col(b)).cast("float").alias("s"))
        one = s.agg(*(F.avg((F.col("s") >= F.lit(t).cast("float")).cast("double")).alias(f"t{n}") for n, t in enumerate(thresholds)))
        return one.select(F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"t{n}").alias(name)) for n, t in enumerate(thresholds)))).alias("x")).select("x.*")

    both = rates(positive, "true_positive_rate").join(rates(negative, "false_positive_rate"), "threshold")
    return both.withColumn("separation", F.col("true_positive_rate") - F.col("false_positive_rate"))


def baseline_comparison(baseline: DataFrame, reranked: DataFrame, relevance: DataFrame, k: int = 50) -> DataFrame:
    """``method, recall``: the fused order against a reranked one (column rank)."""
    one = recall_at_k(baseline, relevance, [k], "rrf_rank").select(F.lit("rrf").alias("method"), F.col("recall_at_k").alias("recall"))
    two = recall_at_k(reranked, relevance, [k], "rank").select(F.lit("reranked").alias("method"), F.col("recall_at_k").alias("recall"))
    return one.unionByName(two)
