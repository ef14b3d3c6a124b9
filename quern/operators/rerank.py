"""Second-stage ranking: scoring, cutting, and trainable rankers.

``train_listwise`` boosts regression trees on the gradient of a listwise loss (the cross entropy between a query's labels and
the softmax of its scores), with an evaluation set, early stopping and the best model kept. ``train_pairwise`` fits a linear
ranker to within-query differences.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.plans.lineage import cut_lineage, discard


def rerank(scored: DataFrame, score: str, k: int = 50, ties: list[Column] | None = None) -> DataFrame:
    """``query_id, item_id, rank``: the ``k`` best by ``score``; ties keep the incoming ``rrf_rank`` order, or go by ``ties``.

    Every task keeps its own ``k`` best rows of a query before they are shuffled.
    """
    w = Window.partitionBy("query_id").orderBy(F.col(score).desc(), *(ties or [F.col("rrf_rank")]))
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select("query_id", "item_id", "rank")


def linear_score(features: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Adds ``score``: a weighted sum of features, nulls as 0."""
    total = F.lit(0.0)
    for c, w in weights.items():
        total = total + F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * w
    return features.withColumn("score", total)


def imputed(features: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """Fills nulls with 0 and adds ``<c>_missing`` indicators."""
    marks = {f"{c}_missing": F.col(c).isNull().cast("double") for c in columns}
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns}
    return features.withColumns(marks).withColumns(filled), [*columns, *marks]


def train_pairwise(features: DataFrame, columns: list[str], iterations: int = 50, negatives: int = 8, seed: int = 42) -> dict[str, float]:
    """Weights of a linear ranker from pairs (relevant, other) of one query.

    Each relevant candidate meets ``negatives`` others, spread over the query's list by a hash, so a long list adds no
    more pairs than a short one. Features are standardised over all rows; weights are given for the raw features.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    filled, names = imputed(features, columns)
    stats = filled.agg(*(F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(c) for c in names)).first().asDict()
    used = [c for c in names if stats[c] > 0]
    if not used:
        return {}
    unit = filled.select("query_id", "item_id", "label", *((F.col(c) / stats[c]).alias(c) for c in used))
    w = Window.partitionBy("query_id").orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col("item_id"))))
    other = unit.where("label = 0").withColumn("slot", F.row_number().over(w)).where(F.col("slot") <= negatives)
    pairs = unit.where("label = 1").alias("p").join(other.alias("n"), "query_id")
    sign = F.when(F.pmod(F.xxhash64("p.item_id", "n.item_id"), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    # Fitting reads the pairs again and again, so the candidates are gone through once for them.
    diffs = cut_lineage(pairs.select(((sign + 1) / 2).alias("y"), *((sign * (F.col(f"p.{c}") - F.col(f"n.{c}"))).alias(c) for c in used)))
    if diffs.isEmpty():
        return {}
    data = VectorAssembler(inputCols=used, outputCol="x").transform(diffs)
    model = LogisticRegression(featuresCol="x", labelCol="y", fitIntercept=False, standardization=False, maxIter=iterations, regParam=0.01).fit(data)
    return {c: float(v) / stats[c] for c, v in zip(used, model.coefficients)}


def apply_pairwise(features: DataFrame, columns: list[str], weights: dict[str, float]) -> DataFrame:
    filled, _ = imputed(features, columns)
    return linear_score(filled, weights)


def assembled(features: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """Adds the feature vector ``x`` (nulls as 0, with indicators), and says what it holds."""
    from pyspark.ml.feature import VectorAssembler

    filled, names = imputed(features, columns)
    return VectorAssembler(inputCols=names, outputCol="x").transform(filled), names


@dataclass
class BoostedRanker:
    """A sum of regression trees; ``history`` has the evaluation recall after each tree, ``trees`` those of the best round."""

    columns: list[str]
    names: list[str]
    rate: float
    trees: list = field(default_factory=list)
    scales: list[float] = field(default_factory=list)
    history: list[float] = field(default_factory=list)

    def score(self, features: DataFrame) -> DataFrame:
        """Adds ``score`` to ``features``."""
        keep = [c for c in features.columns if c != "score"]
        out, _ = assembled(features.withColumn("_kept", F.struct(*keep)), self.columns)
        total = F.lit(0.0)
        for n, (tree, scale) in enumerate(zip(self.trees, self.scales)):
            out = tree.transform(out).withColumnRenamed("_t", f"_t{n}")
            total = total + F.col(f"_t{n}") * (self.rate * scale)
        return out.select("_kept.*", total.alias("score"))

    def importance(self, spark: SparkSession) -> DataFrame:
        """``feature, importance``: mean importance over the trees, by size."""
        totals = [0.0] * len(self.names)
        for tree in self.trees:
            for k, v in enumerate(tree.featureImportances.toArray()):
                totals[k] += float(v) / len(self.trees)
        return spark.createDataFrame(sorted(zip(self.names, totals), key=lambda x: (-x[1], x[0])), "feature string, importance double")


def _recall(rows: DataFrame, k: int) -> float:
    """Mean share of a query's relevant candidates among its ``k`` best by score; a query has a bounded list of candidates."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("rrf_rank"))
    placed = rows.select("query_id", "label", (F.row_number().over(w) <= k).alias("top"))
    per = placed.groupBy("query_id").agg(F.sum("label").alias("n"), F.sum(F.when(F.col("top"), F.col("label")).otherwise(0)).alias("h")).where("n > 0")
    return float(per.agg(F.coalesce(F.avg(F.col("h") / F.col("n")), F.lit(0.0))).first()[0])


def _largest(node) -> float:
    """The largest prediction of a fitted tree's leaves by size; each leaf has training rows."""
    if node.getClass().getSimpleName() == "LeafNode":
        return abs(float(node.prediction()))
    return max(_largest(node.leftChild()), _largest(node.rightChild()))


def train_listwise(train: DataFrame, columns: list[str], evaluation: DataFrame | None = None, iterations: int = 12, rate: float = 0.5, depth: int = 5, patience: int = 3, k: int = 50, seed: int = 42) -> BoostedRanker:
    """Listwise boosting on rows (query_id, item_id, rrf_rank, label, ``columns``), unique by query and item.

    Each round fits a tree to labels / their sum - softmax(scores) within each query; queries without a relevant candidate
    say nothing and are left out. With ``evaluation``, training stops after ``patience`` rounds without a better recall at
    ``k`` there, and only the trees of the best round are kept. Scores and targets are written once a round, so plans stay
    short and rows are shuffled once a round.
    """
    from pyspark.ml.regression import DecisionTreeRegressor

    query = Window.partitionBy("query_id")
    wanted = train.withColumn("_labels", F.sum("label").over(query)).where("_labels > 0")
    data, names = assembled(wanted, columns)
    ranker = BoostedRanker(columns, names, rate)

    def aimed(rows: DataFrame) -> DataFrame:
        # A score grows by at most ``rate`` a round, so exponentials stay small.
        share = F.exp("score") / F.sum(F.exp("score")).over(query)
        return cut_lineage(rows.withColumn("target", F.col("label") / F.col("_labels") - share))

    now = aimed(data.select("query_id", "label", "_labels", "x").withColumn("score", F.lit(0.0)))
    held = None if evaluation is None else cut_lineage(assembled(evaluation, columns)[0].select("query_id", "rrf_rank", "label", "x").withColumn("score", F.lit(0.0)))
    best, best_at = (-1.0, 0)
    for n in range(iterations):
        tree = DecisionTreeRegressor(featuresCol="x", labelCol="target", predictionCol="_t", maxDepth=depth, seed=seed + n).fit(now)
        # The largest step of a tree is ``rate``.
        scale = _largest(tree._java_obj.rootNode()) or 1.0
        ranker.trees.append(tree)
        step = lambda rows: tree.transform(rows).withColumn("score", F.col("score") + F.col("_t") * (rate / scale)).drop("_t")  # noqa: E731, B023
        ranker.scales.append(1.0 / scale)
        if n + 1 < iterations:
            before, now = now, aimed(step(now))
            discard(before)
        if held is not None:
            before, held = held, cut_lineage(step(held))
            discard(before)
            ranker.history.append(_recall(held, k))
            if ranker.history[-1] > best:
                best, best_at = ranker.history[-1], n + 1
            elif n + 1 - best_at >= patience:
                break
    discard(now)
    if held is not None:
        discard(held)
        ranker.trees, ranker.scales = ranker.trees[:best_at], ranker.scales[:best_at]
    return ranker


def importance(weights: dict[str, float], features: DataFrame) -> DataFrame:
    """``feature, importance``: weight times the feature's spread, by size."""
    spark = features.sparkSession
    filled, names = imputed(features, [c for c in weights if not c.endswith("_missing")])
    stats = filled.agg(*(F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(c) for c in weights if c in names)).first().asDict()
    rows = sorted(((c, abs(w) * stats.get(c, 0.0)) for c, w in weights.items()), key=lambda x: (-x[1], x[0]))
    return spark.createDataFrame(rows, "feature string, importance double")
