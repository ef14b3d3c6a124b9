"""Joins of hot keys: the same rows as a plain join, whatever is chunked."""

import random

import pytest
from pyspark.sql import functions as F

from quern.plans import skew


@pytest.mark.parametrize("chunk", [1, 7, 10_000])
def test_joins_of_hot_keys(spark, monkeypatch, chunk):
    monkeypatch.setattr(skew, "HOT_SHARE", 0.0)
    r = random.Random(2)
    a = [("hot" if r.random() < 0.6 else f"k{r.randrange(9)}", k) for k in range(80)] + [(None, 500), ("only a", 501)]
    b = [("hot" if r.random() < 0.4 else f"k{r.randrange(9)}", k) for k in range(60)] + [(None, 600)]
    left, right = spark.createDataFrame(a, "k string, x long"), spark.createDataFrame(b, "k string, y long")
    got = [tuple(z) for z in skew.salted_join(left, right, "k", "x", "y", chunk).select("k", "x", "y").collect()]
    want = {(k, x, y) for k, x in a for q, y in b if k == q and k is not None}
    assert len(got) == len(want) and set(got) == want
    got = [tuple(z) for z in skew.self_pairs(left, "k", "x", chunk).collect()]
    want = {(k, x, y) for k, x in a for q, y in a if k == q and k is not None and x < y}
    assert len(got) == len(want) and set(got) == want
    assert skew.salted_join(left.limit(0), right, "k", "x", "y").count() == 0 and skew.self_pairs(left.where(F.lit(False)), "k", "x").count() == 0
