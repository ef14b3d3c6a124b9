"""Relevance labels from the interaction log, validation samples and the evaluation corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.plans.numbering import numbered
from quern.plans.skew import join_weighted
from quern.sources.tables import ITEM_COLUMNS, QUERY_GROUP_COLUMNS, first_per_key


def _first_known(column: str, order: list[str]):
    """The first non-null value by ``order``; a plain ``min_by`` would also take nulls."""
    return F.min(F.when(F.col(column).isNotNull(), F.struct(*order, F.col(column).alias("_value"))))["_value"]


def _group_key() -> Column:
    """128 bits for (query text, params, category): null params are empty, null text and category are values of their own."""
    part = lambda c: F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n"))
    return F.md5(F.concat_ws("\u0001", part("search_query"), F.coalesce("search_infm_params_text", F.lit("")), part("search_category")))


def relevance_pairs(train: DataFrame) -> DataFrame:
    """Long form: distinct ``group_key, item_id``."""
    return train.where("item_id IS NOT NULL").select(_group_key().alias("group_key"), "item_id").distinct()


def relevance_labels(train: DataFrame, order: list[str] = ["interaction_id", "ingested_at"]) -> DataFrame:
    """One row per (query text, params, category): ``query_id``, first known location and delivery flag, ``n_interactions``
    (with an item), ``n_relevant`` (distinct items) and ``group_key``, by which ``long_relevance`` finds the items.

    Null params are empty; a null query text is a group of its own. Ids follow the sorted groups, nulls last, and are given
    by a range-partitioned sort. The items stay in long form, as a hot search has any number of them.
    """
    rows = train.withColumns({"search_infm_params_text": F.coalesce("search_infm_params_text", F.lit("")), "group_key": _group_key()})
    firsts = rows.groupBy("group_key", *QUERY_GROUP_COLUMNS).agg(
        _first_known("search_location_id", order).alias("search_location_id"),
        _first_known("search_is_delivery_search", order).alias("search_is_delivery_search"),
        F.count("item_id").alias("n_interactions"),
    )
    sizes = relevance_pairs(train).groupBy("group_key").agg(F.count(F.lit(1)).alias("n_relevant"))
    return number_groups(firsts.join(sizes, "group_key", "left").withColumn("n_relevant", F.coalesce("n_relevant", F.lit(0).cast("long"))))


def number_groups(groups: DataFrame) -> DataFrame:
    """Adds ``query_id`` (train_000000, ...) along the sorted group columns, nulls last."""
    keys = [F.col(c).asc_nulls_last() for c in QUERY_GROUP_COLUMNS]
    return numbered(groups, *keys, name="_number").select(F.format_string("train_%06d", "_number").alias("query_id"), *groups.columns)


def seeded_order(seed: int, column: str):
    """A pseudo-random but engine-independent order."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(column)))


def sample_queries(labels: DataFrame, n: int | None, seed: int = 42, max_relevant: int | None = 200) -> DataFrame:
    """``n`` labelled queries with at most ``max_relevant`` relevant items, by seeded hash order; all if fewer are left or
    ``n`` is None."""
    fit = labels if max_relevant is None else labels.where(F.col("n_relevant") <= max_relevant)
    return fit if n is None else fit.orderBy(seeded_order(seed, "query_id"), "query_id").limit(n)


def long_relevance(labels: DataFrame, train: DataFrame) -> DataFrame:
    """``query_id, item_id`` of ``labels``: the items of their groups in the log."""
    pairs = relevance_pairs(train)
    return join_weighted(pairs, labels.select("group_key", "query_id", "n_relevant"), "group_key", "n_relevant", pairs.count()).select("query_id", "item_id")


def evaluation_corpus(items: DataFrame, train: DataFrame, relevance: DataFrame, order: list[str] = ["interaction_id", "ingested_at"]) -> DataFrame:
    """``items`` and, from the log, the items of ``relevance`` that they lack (each by its first interaction), with their
    ``origin``: benchmark or extra."""
    missing = relevance.select("item_id").distinct().join(items.select("item_id"), "item_id", "left_anti")
    extra = first_per_key(train.select(*order, *ITEM_COLUMNS).join(missing, "item_id", "left_semi"), "item_id", order)
    return items.select(*ITEM_COLUMNS, F.lit("benchmark").alias("origin")).unionByName(extra.select(*ITEM_COLUMNS, F.lit("extra").alias("origin")))


def training_queries(labels: DataFrame, validation: DataFrame, train: DataFrame, items: DataFrame, n: int | None, seed: int = 777, max_relevant: int | None = None) -> DataFrame:
    """Labelled queries outside ``validation`` with at least one relevant item among ``items``, sampled by ``seed``; all
    of them if ``n`` is None, however many relevant items they have unless ``max_relevant`` says otherwise."""
    rest = labels.join(validation.select("query_id"), "query_id", "left_anti")
    reached = relevance_pairs(train).join(items.select("item_id").distinct(), "item_id", "left_semi").select("group_key").distinct()
    return sample_queries(rest.join(reached, "group_key", "left_semi").select(*labels.columns), n, seed, max_relevant)


def permuted_pairs(df: DataFrame, id_col: str, seed: int = 0) -> DataFrame:
    """``<id>, other_id``: each id with the one at its place in a seeded shuffle (now and then itself)."""
    ids = df.select(id_col)
    one = numbered(ids, F.col(id_col).asc_nulls_last(), name="_place")
    two = numbered(ids.select(F.col(id_col).alias("other_id")), F.md5(F.concat(F.lit(f"{seed}|"), F.col("other_id").cast("string"))), F.col("other_id"), name="_place")
    return one.join(two, "_place").drop("_place")
