import math
import random

from pyspark.sql import functions as F

from quern.llm.topn import top_n

SCHEMA = "g string, i string, s double, position string"


def brute(rows, n):
    best = {}
    for g, i, s, _ in rows:
        if g is not None and i is not None and s is not None and not math.isnan(s):
            best[g, i] = max(best.get((g, i), -math.inf), s)
    out = set()
    for g in {g for g, _ in best}:
        order = sorted((-s, i) for (x, i), s in best.items() if x == g)
        out |= {(g, i, k + 1) for k, (_, i) in enumerate(order[:n])}
    return out


def test_matches_brute_force_with_a_hot_group_over_many_partitions(spark):
    r = random.Random(3)
    rows = [("hot", f"i{r.randint(0, 4000)}", r.choice([0.1, 0.2, 0.3, -0.0, 0.0]), "x") for _ in range(5000)]
    rows += [(f"g{k % 40}", f"i{r.randint(0, 50)}", r.random(), None) for k in range(600)]
    rows += [(None, "a", 1.0, None), ("g1", None, 9.0, None), ("g1", "n", None, None), ("g1", "m", float("nan"), None), ("one", "x", float("inf"), None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    for n in (1, 10, 900):
        got = [(x["g"], x["i"], x["position"]) for x in top_n(df, "g", "i", "s", n).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows, n)


def test_empty_and_other_types(spark):
    assert top_n(spark.createDataFrame([], SCHEMA), "g", "i", "s", 3).count() == 0
    df = spark.createDataFrame([("a", "x", 1.0, None)], SCHEMA).withColumn("s", F.col("s").cast("float"))
    assert top_n(df, "g", "i", "s", 3).count() == 1
