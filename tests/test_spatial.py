import math
import random

from quern.operators.spatial import near_pairs


def km(a, b):
    (p, q), (r, s) = [[math.radians(x) for x in y] for y in (a, b)]
    h = math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h)))


def brute(rows, radius):
    good = [(i, la, lo) for i, la, lo in rows if i is not None and la is not None and lo is not None and -90 <= la <= 90 and -180 <= lo <= 180]
    return {(a[0], b[0]) for a in good for b in good if a[0] < b[0] and km(a[1:], b[1:]) * 1000 <= radius}


def check(spark, rows, radius):
    df = spark.createDataFrame(rows, "i string, lat double, lon double")
    got = [tuple(r) for r in near_pairs(df, "i", "lat", "lon", radius).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, radius)
    return len(got)


def test_crowded_spot_neighbours_and_dirt(spark):
    r = random.Random(1)
    rows = [(f"h{k}", 55.75, 37.61) for k in range(130)]
    rows += [(f"n{k}", 55.75 + r.uniform(-0.002, 0.002), 37.61 + r.uniform(-0.003, 0.003)) for k in range(150)]
    rows += [(f"f{k}", r.uniform(-60, 60), r.uniform(-179, 179)) for k in range(60)]
    rows += [("x1", None, 37.61), ("x2", 55.75, None), (None, 55.75, 37.61), ("x3", 91.0, 181.0), ("x4", float("nan"), 1.0), rows[0], rows[140]]
    assert check(spark, rows, 25.0) > 130 * 129 / 2


def test_poles_and_date_line(spark):
    rows = [("a", 89.9999, 10.0), ("b", 89.9999, -170.0), ("c", 0.0, 179.9999), ("d", 0.0, -179.9999), ("e", -90.0, 0.0), ("f", -90.0, 120.0)]
    assert check(spark, rows, 25.0) == 3


def test_other_radii(spark):
    r = random.Random(2)
    rows = [(f"p{k}", r.uniform(50, 50.2), r.uniform(30, 30.2)) for k in range(120)]
    for radius in (3.0, 1000.0, 30000.0):
        check(spark, rows, radius)


def test_empty(spark):
    assert near_pairs(spark.createDataFrame([], "i string, lat double, lon double"), "i", "lat", "lon", 25.0).count() == 0
