"""The five ranking signals. Each can be scored on a frame of (query, item) pairs, or replaced by another column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.geo import haversine_km
from quern.functions.text import Tokenizer, full_text, tokens
from quern.functions.vectors import block_products, dot, mean_vectors
from quern.operators.blocks import coverage_totals
from quern.plans.lineage import cut_lineage
from quern.plans.skew import salted_join


def distinct_tokens(text: Column, tokenizer: Tokenizer = tokens) -> Column:
    """Distinct tokens in the order in which they first occur."""
    return F.array_distinct(tokenizer(text))


def postings(items: DataFrame, id_col: str, token_col: str) -> DataFrame:
    """Inverted index: distinct (token, item)."""
    return items.select(F.explode(token_col).alias("token"), F.col(id_col)).distinct()


def coverage(query_tokens: Column, item_tokens: Column) -> Column:
    """Share of the query's distinct tokens that the item has, as float; 0 if the query has none. Both sides distinct."""
    n = F.size(query_tokens)
    return F.when(n > 0, F.size(F.array_intersect(query_tokens, item_tokens)) / n).otherwise(0.0).cast("float")


def sparse_coverage(queries: DataFrame, items: DataFrame, query_id: str, item_id: str, query_tokens: str, item_tokens: str, semantic: DataFrame | None = None) -> DataFrame:
    """``query_id, item_id, score`` of all pairs with a common token: an equi-join on the token, hot tokens in chunks.

    ``semantic`` (token, item_id) adds matches of tokens that the item doesn't hold literally. Pairs without a match
    score 0 and don't come out. The result has a row for every pair that shares a token; ``coverage_summary`` does without.
    """
    wanted = queries.select(query_id, F.explode(query_tokens).alias("token"), F.size(query_tokens).alias("n")).distinct()
    found = postings(items, item_id, item_tokens)
    if semantic is not None:
        found = found.unionByName(semantic.select("token", item_id)).distinct()
    met = salted_join(wanted, found, "token", query_id, item_id)
    return met.groupBy(query_id, item_id).agg((F.count(F.lit(1)) / F.max("n")).cast("float").alias("score"))


def coverage_summary(
    queries: DataFrame, items: DataFrame, query_id: str, item_id: str, query_tokens: str, item_tokens: str, semantic: DataFrame | None = None, near: tuple[DataFrame, DataFrame, float] | None = None
) -> DataFrame:
    """``query_id, n_items, best, total``: how many items share a token with the query, the highest coverage and the sum.

    As ``sparse_coverage``, summed by query, but without its pairs: each query is counted against blocks of items. A query
    without a match doesn't come out. ``near`` is (vocabulary, vectors, threshold) and adds ``semantic_matches(vocabulary,
    vectors, item_id, threshold)`` without a table of them; each item of ``vectors`` once, and those that aren't in ``items``
    have no tokens of their own.
    """
    found = items.select(item_id, F.col(item_tokens).alias("ts"))
    if semantic is not None:
        found = found.unionByName(semantic.select(item_id, F.array("token").alias("ts")))
    sets = found.groupBy(item_id).agg(F.array_distinct(F.flatten(F.collect_list("ts"))).alias("ts"))
    asked = cut_lineage(queries.where(F.size(query_tokens) > 0).select(query_id, F.col(query_tokens).alias("ts")).distinct())
    if near is None:
        return coverage_totals(asked, sets.select("ts"), query_id)
    vocabulary, vectors, threshold = near
    sets = sets.join(vectors.select(item_id, "embedding"), item_id, "full").select(F.coalesce("ts", F.array().cast("array<string>")).alias("ts"), "embedding")
    return coverage_totals(asked, sets, query_id, vocabulary, threshold)


def semantic_matches(vocabulary: DataFrame, items: DataFrame, item_id: str, threshold: float) -> DataFrame:
    """``token, item_id`` where the token's vector and the item's reach ``threshold``, compared as float.

    The vocabulary (token, embedding) meets the items (item_id, embedding) block by block; null vectors match nothing.
    """
    return block_products(vocabulary, items, "token", item_id, threshold=threshold).select("token", item_id)


def semantic_coverage(query_tokens: Column, item_tokens: Column, item_semantic: Column) -> Column:
    """``coverage`` where a token also counts as found if it is among the item's semantic matches (null: none)."""
    n = F.size(query_tokens)
    both = F.array_union(item_tokens, F.coalesce(item_semantic, F.array().cast("array<string>")))
    return F.when(n > 0, F.size(F.array_intersect(query_tokens, both)) / n).otherwise(0.0).cast("float")


def location_centroids(items: DataFrame, location: str = "item_location_id", lat: str = "item_latitude", lon: str = "item_longitude") -> DataFrame:
    """``location_id, centroid_lat, centroid_lon``: means over all items with both coordinates; a null location has none.

    Sums of decimals are exact, so the result doesn't depend on the order of rows.
    """
    known = items.where(F.col(location).isNotNull() & F.col(lat).isNotNull() & F.col(lon).isNotNull())
    mean = lambda c: (F.sum(c).cast("double") / F.count(F.lit(1)))
    return known.groupBy(F.col(location).alias("location_id")).agg(mean(lat).alias("centroid_lat"), mean(lon).alias("centroid_lon"))


def location_distance_km(q_loc: Column, c_lat: Column, c_lon: Column, i_loc: Column, lat: Column, lon: Column) -> Column:
    """0 for the same location, else the distance from the query location's centroid; null if either is unknown."""
    return F.when(q_loc == i_loc, F.lit(0.0)).otherwise(haversine_km(c_lat, c_lon, lat, lon))


def location_match(q_loc: Column, c_lat: Column, c_lon: Column, i_loc: Column, lat: Column, lon: Column, decay_km: float = 5.0) -> Column:
    """1 for the same location, else exp(-distance / decay), 0 where coordinates or the centroid are unknown; as float."""
    d = haversine_km(c_lat, c_lon, lat, lon)
    return F.when(q_loc == i_loc, F.lit(1.0)).otherwise(F.coalesce(F.exp(-d / decay_km), F.lit(0.0))).cast("float")


def dense_similarity(a: Column, b: Column) -> Column:
    """Dot product of normalised vectors as float; 0 if one is missing."""
    return F.coalesce(dot(a, b), F.lit(0.0)).cast("float")


def nonzero(v: Column) -> Column:
    """The places and values of a vector that aren't 0."""
    return F.filter(F.transform(v, lambda x, i: F.struct(i.alias("i"), x.cast("double").alias("v"))), lambda e: e["v"] != 0)


def sparse_similarity(a: Column, b: Column) -> Column:
    """``dense_similarity`` for a left side given by ``nonzero``: the same sum in the same order, without its zero terms."""
    return F.coalesce(F.aggregate(a, F.lit(0.0), lambda s, e: s + e["v"] * F.get(b, e["i"]).cast("double")), F.lit(0.0)).cast("float")


def microcat_centroids(items: DataFrame, microcat: str = "item_microcat_id", vector: str = "embedding") -> DataFrame:
    """``microcat, centroid, n`` over the whole corpus; a null microcategory is one of its own."""
    return mean_vectors(items, microcat, vector)


def microcat_scores(queries: DataFrame, centroids: DataFrame, query_id: str, microcat: str = "item_microcat_id") -> DataFrame:
    """``query_id, microcat, score`` of each query against each centroid: scored once per microcategory, then looked up."""
    return block_products(queries, centroids.withColumnRenamed("centroid", "embedding"), query_id, microcat).withColumnRenamed("similarity", "score")


def item_text_tokens(tokenizer: Tokenizer = tokens) -> Column:
    return distinct_tokens(full_text(F.col("item_title_raw"), F.col("item_description_raw")), tokenizer)
