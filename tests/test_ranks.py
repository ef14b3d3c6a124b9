"""Running sums, ranks and quantiles against brute force, with groups across many partitions."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quern.plans import ranks


@pytest.mark.parametrize("partitions", ["1", "7", "40"])
def test_running_sums(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        r = random.Random(int(partitions))
        rows = [(r.choice(["hot", "hot", "hot", "a", None, f"k{r.randrange(30)}"]), k, r.randrange(1, 5)) for k in range(400)] + [("single", 1, 2)]
        r.shuffle(rows)
        got = {(x["g"], x["o"]): (x["before"], x["alone"]) for x in ranks.running_sums(spark.createDataFrame(rows, "g string, o long, w long"), ["g"], [F.col("o").desc()], "w").collect()}
        groups = defaultdict(list)
        for g, o, w in rows:
            groups[g].append((o, w))
        want = {(g, o): (sum(w2 for o2, w2 in x if o2 > o), len(x) == 1) for g, x in groups.items() for o, _ in x}
        assert got == want
        values = [("x", float(r.randrange(6))) for _ in range(97)] + [("y", 1.0)]
        df = spark.createDataFrame(values, "g string, v double")
        q = {(x["g"], x["share"]): x["quantile"] for x in ranks.quantiles(df, "g", "v", [0.25, 0.5, 0.9]).collect()}
        want = {(x["g"], s): v for x in df.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, (0.25, 0.5, 0.9)))).alias("p")).collect() for s, v in zip((0.25, 0.5, 0.9), x["p"])}
        assert q == pytest.approx(want)
        assert ranks.running_sums(df.withColumn("w", F.lit(1).cast("long")).limit(0), ["g"], [F.col("v")], "w").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
