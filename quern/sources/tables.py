"""Reading the three input tables, caching embeddings by content, and writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

# Column lists of the inputs.
QUERY_COLUMNS = ["search_query", "search_location_id", "search_is_delivery_search", "search_infm_params_text", "search_category"]
QUERY_GROUP_COLUMNS = ["search_query", "search_infm_params_text", "search_category"]
ITEM_COLUMNS = ["item_id", "item_title_raw", "item_description_raw", "item_infm_params_text", "item_category_id", "item_microcat_id", "item_location_id", "item_latitude", "item_longitude"]
ITEM_FEATURE_COLUMNS = ["item_id", "item_category_id", "item_microcat_id", "item_location_id", "item_latitude", "item_longitude", "item_price", "item_rating", "item_rating_reviews_count", "item_is_phone_hidden", "item_is_message_forbidden"]
QUERY_FEATURE_COLUMNS = ["search_location_id", "search_is_delivery_search", "search_category"]
_DECIMALS = ("item_price", "item_latitude", "item_longitude")
_FLOATS = ("item_rating",)


def checked(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with exactly ``columns``; says which are missing."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns missing: {missing}")
    return df.select(*columns)


def clean_dtypes(df: DataFrame) -> DataFrame:
    """Decimals as double, NaN as null, where such columns are present."""
    out = {c: F.col(c).cast("double") for c in _DECIMALS if c in df.columns}
    out |= {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in _FLOATS if c in df.columns}
    return df.withColumns(out) if out else df


def table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{data_dir}/{name}.parquet")


def load_dataset(spark: SparkSession, data_dir: str) -> dict[str, DataFrame]:
    """``train``, ``benchmark_queries`` and ``benchmark_items``, each with its needed columns only."""
    return {
        "train": checked(table(spark, data_dir, "train"), [*QUERY_COLUMNS, *ITEM_COLUMNS]),
        "benchmark_queries": checked(table(spark, data_dir, "benchmark_queries"), ["query_id", *QUERY_COLUMNS]),
        "benchmark_items": checked(table(spark, data_dir, "benchmark_items"), ITEM_COLUMNS),
    }


def load_train_features(spark: SparkSession, data_dir: str) -> DataFrame:
    return clean_dtypes(checked(table(spark, data_dir, "train"), [*QUERY_FEATURE_COLUMNS, *ITEM_FEATURE_COLUMNS]))


def load_item_features(spark: SparkSession, data_dir: str) -> DataFrame:
    return clean_dtypes(checked(table(spark, data_dir, "benchmark_items"), ITEM_FEATURE_COLUMNS))


def first_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per ``key`` (null too), the first by ``order`` and then by all other columns, so that the choice is fixed.

    The choice is an aggregation with map-side combining, so a key with many rows is no hot spot.
    """
    rest = [c for c in df.columns if c not in (key, *order)]
    whole = F.struct(*(F.col(c) for c in [*order, *rest]))
    picked = df.groupBy(F.col(key)).agg(F.min(whole).alias("_first"))
    return picked.select(*(F.col(key) if c == key else F.col(f"_first.{c}").alias(c) for c in df.columns))


def load_train_item_feature_lookup(spark: SparkSession, data_dir: str) -> DataFrame:
    """Item features from the log, one row per item: those of its earliest interaction."""
    raw = clean_dtypes(checked(table(spark, data_dir, "train"), ["interaction_id", "ingested_at", *ITEM_FEATURE_COLUMNS]))
    return first_per_key(raw.where("item_id IS NOT NULL"), "item_id", ["interaction_id", "ingested_at"]).drop("interaction_id", "ingested_at")


def embedding_key(model: str, prefix: str, text: str):
    """Content address of an embedding: SHA-1 over model, prefix and text."""
    if prefix not in ("query", "passage"):
        raise ValueError("prefix must be 'query' or 'passage'")
    return F.sha1(F.concat_ws("|", F.lit(model), F.lit(prefix), F.coalesce(F.col(text), F.lit(""))).cast("binary"))


def cached_embeddings(texts: DataFrame, text: str, embed, model: str, prefix: str, cache_path: str | None = None) -> DataFrame:
    """Adds ``embedding``; distinct texts not yet in the cache are embedded once and appended to it.

    ``embed(df, key, text)`` returns (key, embedding). Without a cache path nothing is stored.
    """
    keyed = texts.withColumn("_key", embedding_key(model, prefix, text))
    wanted = keyed.groupBy("_key").agg(F.min(F.concat(F.lit(f"{prefix}: "), F.coalesce(F.col(text), F.lit("")))).alias("_text"))
    if cache_path is None:
        known = embed(wanted, "_key", "_text")
    else:
        spark = texts.sparkSession
        try:
            wanted = wanted.join(spark.read.parquet(cache_path).select("_key"), "_key", "left_anti")
        except AnalysisException:  # no cache yet
            pass
        embed(wanted, "_key", "_text").write.mode("append").parquet(cache_path)
        # Two writers may have added the same text.
        known = spark.read.parquet(cache_path).groupBy("_key").agg(F.first("embedding").alias("embedding"))
    return keyed.join(known.select("_key", "embedding"), "_key", "left").drop("_key")


def write_candidates(packed: DataFrame, path: str) -> None:
    """(query_id, candidate_item_ids, n_candidates) as parquet."""
    checked(packed, ["query_id", "candidate_item_ids", "n_candidates"]).write.mode("overwrite").parquet(path)


def write_answer(answer: DataFrame, path: str, order: str | None = None) -> None:
    """(query_id, answer) as CSV with a header, in the order of ``order``: column ``position`` where the answer has one (the
    order in which queries were asked), else by query_id. The files are sorted parts of one global order."""
    by = order or ("position" if "position" in answer.columns else "query_id")
    answer.orderBy(by).select("query_id", "answer").write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)
