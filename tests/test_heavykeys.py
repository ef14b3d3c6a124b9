from collections import Counter

from pyspark.sql import functions as F

from quern.operators.heavykeys import distinct_per_key, heavy_keys, key_profile


def test_heavy_keys_counts_null_rows_in_the_total(spark):
    rows = [(1,)] * 50 + [(2,)] * 5 + [(None,)] * 40 + [(k,) for k in range(10, 15)]
    df = spark.createDataFrame(rows, "k long")
    assert {(r["category_id"], r["n_rows"], r["n_total"]) for r in heavy_keys(df, "k").collect()} == {(1, 50, 100), (2, 5, 100)}


def test_empty_table_and_clashing_column(spark):
    empty = spark.createDataFrame([], "k long, n_rows string, category_id string")
    assert heavy_keys(empty, "k").count() == 0 and key_profile(empty, "k").count() == 0
    one = spark.createDataFrame([(1, "x", "y")], "k long, n_rows string, category_id string")
    assert [tuple(r) for r in key_profile(one, "k").collect()] == [(1, 1)]


def test_profile_matches_brute_force(spark):
    rows = [(k % 3 if k % 7 else None, float(k)) for k in range(200)]
    df = spark.createDataFrame(rows, "k long, v double")
    got = {r["category_id"]: (r["n_rows"], r["s"]) for r in key_profile(df, "k", {"s": F.sum("v")}).collect()}
    counts = Counter(k for k, _ in rows)
    assert got == {k: (n, sum(v for x, v in rows if x == k)) for k, n in counts.items()}


def test_distinct_per_key(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, None), (None, "c")], "k long, v string")
    assert {(r[0], r[1]) for r in distinct_per_key(df, "k", "v").collect()} == {(1, 2), (None, 1)}
