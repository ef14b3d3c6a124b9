"""Building and checking the answer table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the form of an item id.
ITEM_ID = "^[0-9a-f]{16}$"


def build_answer(predictions: DataFrame, query_ids: DataFrame, max_candidates: int = 50, rank: str = "rank") -> DataFrame:
    """``query_id, answer`` for each distinct query id: its first ``max_candidates`` ids, then without repeats, by spaces;
    an empty answer where there is no prediction. Where ``query_ids`` have a ``position``, the answer keeps it (the first of a
    repeated id), so that it can be written in that order."""
    kept = predictions.where(F.col(rank) <= max_candidates) if rank in predictions.columns else predictions
    lists = kept.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), "item_id"))).alias("x"))
    ids = F.array_distinct(F.slice(F.transform("x", lambda s: s["item_id"]), 1, max_candidates))
    answers = lists.select("query_id", F.array_join(ids, " ").alias("answer"))
    if "position" in query_ids.columns:
        asked = query_ids.groupBy("query_id").agg(F.min("position").alias("position"))
        return asked.join(answers, "query_id", "left").select("query_id", F.coalesce("answer", F.lit("")).alias("answer"), "position")
    return query_ids.select("query_id").distinct().join(answers, "query_id", "left").select("query_id", F.coalesce("answer", F.lit("")).alias("answer"))


def validate_answer(answer: DataFrame, query_ids: DataFrame, items: DataFrame, max_candidates: int = 50) -> DataFrame:
    """Problems as rows ``code, n, examples`` (at most 3, sorted); no rows mean a valid answer.

    Codes: columns (then nothing else is checked), row_count, duplicate_query, missing_query, unexpected_query, too_long,
    duplicate_items, malformed_item, unknown_item (only well-formed ids are looked up).
    """
    spark = answer.sparkSession
    schema = "code string, n long, examples array<string>"
    if answer.columns != ["query_id", "answer"]:
        return spark.createDataFrame([("columns", len(answer.columns), answer.columns[:3])], schema)
    expected = query_ids.select("query_id").distinct()
    # Three least examples are kept while aggregating, so no group is collected.
    three = lambda c: F.slice(F.array_sort(F.collect_set(c)), 1, 3)

    def example(df: DataFrame, column: str, code: str) -> DataFrame:
        least = df.select(F.col(column).cast("string").alias("e")).distinct().orderBy("e").limit(3).agg(three("e").alias("examples"))
        count = df.agg(F.count(F.lit(1)).alias("n"))
        return count.join(F.broadcast(least), F.lit(True)).where("n > 0").select(F.lit(code).alias("code"), "n", "examples")

    none = F.array().cast("array<string>")
    sizes = answer.agg(F.count(F.lit(1)).alias("have")).join(F.broadcast(expected.agg(F.count(F.lit(1)).alias("want"))), F.lit(True))
    rows = sizes.where("have <> want").select(F.lit("row_count").alias("code"), F.col("have").alias("n"), none.alias("examples"))
    repeated = answer.groupBy("query_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    ids = F.when(F.col("answer") == "", none).otherwise(F.split("answer", " "))
    lists = answer.select("query_id", ids.alias("ids"))
    single = lists.select("query_id", F.explode("ids").alias("item_id"))
    shown = F.concat(F.col("query_id"), F.lit(": "), F.col("item_id")).alias("e")
    good = F.col("item_id").rlike(ITEM_ID)
    unknown = single.where(good).join(items.select("item_id").distinct(), "item_id", "left_anti")
    parts = [
        example(repeated, "query_id", "duplicate_query"),
        example(expected.join(answer, "query_id", "left_anti"), "query_id", "missing_query"),
        example(answer.select("query_id").distinct().join(expected, "query_id", "left_anti"), "query_id", "unexpected_query"),
        example(lists.where(F.size("ids") > max_candidates), "query_id", "too_long"),
        example(lists.where(F.size("ids") > F.size(F.array_distinct("ids"))), "query_id", "duplicate_items"),
        example(single.where(~good).select(shown), "e", "malformed_item"),
        example(unknown.select(shown), "e", "unknown_item"),
    ]
    for p in parts:
        rows = rows.unionByName(p)
    return rows
