"""Core queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.heavykeys import distinct_per_key, heavy_keys, key_profile
from quern.operators.spatial import near_pairs

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [heavy_keys(read(spark, d, t), k).select(F.lit(t).alias("table_name"), "category_id") for t, k in (("benchmark_items", "item_category_id"), ("train", "search_category"))]
    return parts[0].unionByName(parts[1])


def p2_profile(spark: SparkSession, d: str) -> DataFrame:
    """Complete per-category results of both tables."""
    out = []
    for t, k in (("benchmark_items", "item_category_id"), ("train", "search_category")):
        df = read(spark, d, t)
        price = F.when(F.col("item_price") > 0, F.col("item_price"))
        measures = {
            "n_priced": F.count(price), "sum_price": F.sum(price).cast("decimal(28,2)"), "min_price": F.min(price), "max_price": F.max(price),
            "n_rated": F.count(F.nanvl("item_rating", F.lit(None).cast("double"))), "avg_rating": F.round(F.avg(F.nanvl("item_rating", F.lit(None).cast("double"))), 6),
            "n_reviews": F.sum("item_rating_reviews_count"),
        }
        distinct = distinct_per_key(df, k, "item_id").withColumnRenamed("n_distinct", "n_items")
        profile = key_profile(df, k, measures)
        joined = profile.join(distinct, profile["category_id"].eqNullSafe(distinct["category_id"]), "left").drop(distinct["category_id"])
        out.append(joined.select(F.lit(t).alias("table_name"), "category_id", "n_rows", *measures, F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items")))
    return out[0].unionByName(out[1])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = near_pairs(read(spark, d, "benchmark_items"), "item_id", "item_latitude", "item_longitude", 25.0)
    return pairs.select(F.col("id_a").alias("item_id_a"), F.col("id_b").alias("item_id_b"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p2_found, p2_profile, p3_found)}


_P2 = """
SELECT 'benchmark_items' AS table_name, item_category_id AS category_id FROM benchmark_items WHERE item_category_id IS NOT NULL
GROUP BY 2 HAVING count(*) >= 0.05 * (SELECT count(*) FROM benchmark_items)
UNION ALL
SELECT 'train', search_category FROM train WHERE search_category IS NOT NULL
GROUP BY 2 HAVING count(*) >= 0.05 * (SELECT count(*) FROM train)
"""


def _p2_profile(table: str, key: str) -> str:
    price = "CASE WHEN item_price > 0 THEN item_price END"
    rating = "CASE WHEN NOT isnan(item_rating) THEN item_rating END"
    return f"""
SELECT '{table}' AS table_name, {key} AS category_id, count(*) AS n_rows, count({price}) AS n_priced, CAST(sum({price}) AS DECIMAL(28,2)) AS sum_price,
  min({price}) AS min_price, max({price}) AS max_price, count({rating}) AS n_rated, round(avg({rating}), 6) AS avg_rating,
  CAST(sum(item_rating_reviews_count) AS BIGINT) AS n_reviews, count(DISTINCT item_id) AS n_items
FROM {table} GROUP BY 2
"""


_P3 = """
WITH p AS (
  SELECT DISTINCT item_id, CAST(item_latitude AS DOUBLE) AS la, CAST(item_longitude AS DOUBLE) AS lo FROM benchmark_items
  WHERE item_id IS NOT NULL AND item_latitude BETWEEN -90 AND 90 AND item_longitude BETWEEN -180 AND 180)
SELECT DISTINCT a.item_id AS item_id_a, b.item_id AS item_id_b
FROM p a JOIN p b ON a.item_id < b.item_id AND abs(a.la - b.la) < 0.001
WHERE 2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(b.la - a.la) / 2), 2)
  + cos(radians(a.la)) * cos(radians(b.la)) * pow(sin(radians(b.lo - a.lo) / 2), 2)))) <= 25.0
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _P2,
        "p2_profile": _p2_profile("benchmark_items", "item_category_id") + " UNION ALL " + _p2_profile("train", "search_category"),
        "p3_found": _P3,
    }
