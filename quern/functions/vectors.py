"""Vectors as array columns: products accumulate in double, stored vectors are float."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

#: Rows of each side that meet in one matrix product.
LEFT_BLOCK, RIGHT_BLOCK = 1024, 16_384


def dot(a: Column, b: Column) -> Column:
    """Dot product in double, in index order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def l2_normalize(v: Column) -> Column:
    """``v`` divided by its length, as float; a zero vector stays zero."""
    scaled = lambda d: bound(F.sqrt(dot(d, d)), lambda n: F.transform(d, lambda x: (x.cast("double") / F.when(n == 0, 1.0).otherwise(n)).cast("float")))
    return bound(v, scaled)


def mean_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``key, centroid, n``: the L2-normalised mean of each key's vectors (null is a key of its own); null vectors don't count.

    Positions are aggregated as rows, so a key with most of the vectors is still combined map-side.
    """
    rows = df.where(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.posexplode(vector).alias("pos", "v"))
    means = rows.groupBy("k", "pos").agg(F.avg(F.col("v").cast("double")).alias("m"), F.count(F.lit(1)).alias("n"))
    packed = means.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("ms"), F.max("n").alias("n"))
    return packed.select(F.col("k").alias(key), l2_normalize(F.transform("ms", lambda s: s["m"])).alias("centroid"), "n")


def hash_embedding(df: DataFrame, id_col: str, tokens: str, dim: int = 64, name: str = "embedding") -> DataFrame:
    """``id_col, <name>``: a deterministic text embedder without a model. Each token adds +1 or -1 at a place chosen by its
    MD5 digest; the vector is L2-normalised float. No tokens give the zero vector. Any other embedder with the same
    signature can take its place."""
    place = F.conv(F.substring(F.md5("t"), 1, 4), 16, 10).cast("int") % dim
    sign = F.when(F.substring(F.md5("t"), 5, 1) < "8", 1).otherwise(-1)
    rows = df.select(F.col(id_col).alias("k"), F.explode_outer(tokens).alias("t")).groupBy("k", place.alias("place")).agg(F.sum(sign).alias("v"))
    packed = rows.groupBy("k").agg(F.map_from_entries(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "v")))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0)).cast("float"))
    return packed.select(F.col("k").alias(id_col), l2_normalize(dense).alias(name))


def hash_vectors(lists: pa.ListArray, dim: int = 64) -> np.ndarray:
    """The vectors of ``hash_embedding``, one row of floats for each list of tokens (null is empty)."""
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()) if lists.null_count == 0 else lists.value_lengths().fill_null(0).to_numpy())
    codes = lists.flatten().dictionary_encode()
    known = codes.is_valid().to_numpy(zero_copy_only=False)
    digests = [hashlib.md5(t.encode()).digest() for t in codes.dictionary.to_pylist()]
    place = np.array([int.from_bytes(d[:2], "big") % dim for d in digests], "int64")
    sign = np.array([1.0 if d[2] < 128 else -1.0 for d in digests])
    code = codes.indices.filter(codes.is_valid()).to_numpy()
    total = np.bincount(row[known] * dim + place[code], sign[code], len(lists) * dim).reshape(-1, dim) if len(lists) else np.zeros((0, dim))
    size = np.sqrt((total * total).sum(1, keepdims=True))
    return (total / np.where(size == 0, 1.0, size)).astype("float32")


def with_hash_vectors(df: DataFrame, tokens: str, dim: int = 64, name: str = "embedding") -> DataFrame:
    """``df`` with each row's vector by ``hash_embedding``, whatever the row's id; rows stay where they are."""

    def run(batches):
        for batch in batches:
            v = hash_vectors(batch.column(tokens), dim)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * dim, pa.int32()), pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, listed], [*batch.schema.names, name])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(name, ArrayType(FloatType()))]))


def block_products(left: DataFrame, right: DataFrame, left_id: str, right_id: str, vector: str = "embedding", threshold: float | None = None, k: int | None = None) -> DataFrame:
    """``<left_id>, <right_id>, similarity`` (dot product as float), block against block as matrix products in double.

    Kept inside the block are the pairs that reach ``threshold``, compared as float, or each left row's ``k`` best of the
    block, ties to the smaller id (the best of all blocks are still to be chosen), or all pairs. Null vectors take no part.
    """
    a = left.where(F.col(vector).isNotNull()).select(F.col(left_id).alias("a"), F.col(vector).alias("v"))
    b = right.where(F.col(vector).isNotNull()).select(F.col(right_id).alias("b"), F.col(vector).alias("v"))
    zero = F.lit(0).cast("long")
    n_a, n_b = max(1, -(-a.count() // LEFT_BLOCK)), max(1, -(-b.count() // RIGHT_BLOCK))
    a = a.withColumn("x", F.pmod(F.xxhash64("a"), F.lit(n_a))).withColumn("y", F.explode(F.sequence(zero, zero + (n_b - 1))))
    b = b.withColumn("y", F.pmod(F.xxhash64("b"), F.lit(n_b))).withColumn("x", F.explode(F.sequence(zero, zero + (n_a - 1))))

    def run(one: pa.Table, two: pa.Table) -> pa.Table:
        ids = [one.column("a").combine_chunks(), two.column("b").combine_chunks()]
        if one.num_rows and two.num_rows:
            u, v = (np.array(t.column("v").combine_chunks().flatten().to_numpy(), "float64").reshape(t.num_rows, -1) for t in (one, two))
            s = (u @ v.T).astype("float32")
            if threshold is not None:
                i, j = np.nonzero(s >= np.float32(threshold))
            elif k is not None and k < s.shape[1]:
                bar = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                i, j = np.nonzero(s >= bar[:, None])
            else:
                i, j = (x.ravel() for x in np.indices(s.shape))
            value = s[i, j]
        else:
            i = j = np.zeros(0, "int64")
            value = np.zeros(0, "float32")
        return pa.table({left_id: ids[0].take(pa.array(i)), right_id: ids[1].take(pa.array(j)), "similarity": value})

    kinds = dict(left.dtypes)[left_id], dict(right.dtypes)[right_id]
    return a.groupBy("x", "y").cogroup(b.groupBy("x", "y")).applyInArrow(run, f"{left_id} {kinds[0]}, {right_id} {kinds[1]}, similarity float")
