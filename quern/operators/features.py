"""Feature table of the reranker."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the features a reranker may see; ids and labels are not among them.
FEATURE_COLUMNS = [
    "params_coverage_score", "text_coverage_score", "text_similarity_score", "location_match_score", "location_distance_km", "microcat_match_score", "rrf_score", "rrf_rank",
    "item_rating", "item_rating_reviews_count_log1p", "item_price_log1p", "item_is_phone_hidden", "item_is_message_forbidden", "search_is_delivery_search",
]


def item_content_features(df: DataFrame) -> DataFrame:
    """Rating, log1p of reviews and of a positive price, and both flags as int; nulls stay null."""
    price = F.when(F.col("item_price").cast("double") > 0, F.col("item_price").cast("double"))
    return df.select(
        "item_id",
        F.nanvl(F.col("item_rating").cast("double"), F.lit(None).cast("double")).alias("item_rating"),
        F.log1p(F.col("item_rating_reviews_count").cast("double")).alias("item_rating_reviews_count_log1p"),
        F.log1p(price).alias("item_price_log1p"),
        F.col("item_is_phone_hidden").cast("int").alias("item_is_phone_hidden"),
        F.col("item_is_message_forbidden").cast("int").alias("item_is_message_forbidden"),
    )


def features_by_priority(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of ``first`` and, for ids it lacks, of ``second``; one row per id (the least by all columns)."""
    one = first.groupBy("item_id").agg(F.min(F.struct(*(c for c in first.columns if c != "item_id"))).alias("x"))
    rest = second.join(first.select("item_id").distinct(), "item_id", "left_anti")
    two = rest.groupBy("item_id").agg(F.min(F.struct(*(c for c in first.columns if c != "item_id"))).alias("x"))
    return one.unionByName(two).select("item_id", "x.*")


def feature_table(candidates: DataFrame, content: DataFrame, relevance: DataFrame | None = None, query_features: DataFrame | None = None) -> DataFrame:
    """Candidates with item content, optional query features (query_id, ...), and ``label`` where relevance is given.

    Left joins: a candidate without content keeps nulls; without relevance its label is 0. The right sides must have one
    row per key, as the operators above give.
    """
    out = candidates.join(content, "item_id", "left")
    if query_features is not None:
        out = out.join(query_features, "query_id", "left")
    if relevance is not None:
        known = relevance.select("query_id", "item_id").distinct().withColumn("_known", F.lit(1))
        out = out.join(known, ["query_id", "item_id"], "left").withColumn("label", F.coalesce("_known", F.lit(0))).drop("_known")
    return out
