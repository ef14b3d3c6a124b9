"""Points near other points: a distributed dual-tree self-join.

An octree over the sphere's Cartesian coordinates is built with one aggregation; it is only as deep as the points are
dense: a node with at most ``LEAF_POINTS`` points, or whose points all lie within the radius of each other, is a leaf.
The join then descends the tree with itself one level at a time. Each pair of nodes is discarded when their bounding
boxes are further apart than the radius, kept as certainly near when no two of their points can be further apart, or
else replaced by the pairs of their children. Points are touched only at the leaves, where certainly-near pairs skip the
distance; a leaf with many points is cut into salted chunks, so a crowded spot is spread over many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.geo import EARTH_RADIUS_KM, haversine_km, on_sphere
from quern.plans.lineage import cut_lineage

#: A node with at most so many points isn't divided.
LEAF_POINTS = 48
#: Points of a crowded leaf that one task takes as one side.
CHUNK = 1024
#: Metres by which boxes are widened against rounding.
SLACK_M = 1e-5

_BOX = ("x0", "x1", "y0", "y1", "z0", "z1")


def usable_points(df: DataFrame, id_col: str, lat: str, lon: str) -> DataFrame:
    """Distinct ``id, lat, lon`` (double) of rows with an id and both coordinates inside their ranges."""
    return (
        df.select(F.col(id_col).alias("id"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))
        .where(F.col("id").isNotNull() & F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))
        .distinct()
    )


def _levels(radius_m: float) -> list[int]:
    """Octree levels used, coarse to fine: the first has cells wider than the radius, the last has cells inside it."""
    wide = 2000.0 * EARTH_RADIUS_KM
    last = min(20, max(1, math.ceil(math.log2(wide * math.sqrt(3) / radius_m))))
    first = max(0, min(4, math.floor(math.log2(wide / radius_m)) - 1))
    steps = [first]
    while steps[-1] < last:
        steps.append(min(last, steps[-1] + (3 if steps[-1] < 10 else 2)))
    return steps


def _key(level: Column | int, last: int, *shifted: Column) -> Column:
    x, y, z = (F.shiftright(c, last - level) for c in shifted)
    return F.shiftleft(x, 42).bitwiseOR(F.shiftleft(y, 21)).bitwiseOR(z)


def _gap2(a: str, b: str) -> Column:
    """Square of the least distance between the boxes of two nodes."""
    total = F.lit(0.0)
    for axis in "xyz":
        d = F.greatest(F.lit(0.0), F.col(f"{a}{axis}0") - F.col(f"{b}{axis}1"), F.col(f"{b}{axis}0") - F.col(f"{a}{axis}1"))
        total = total + d * d
    return total


def _reach2(a: str, b: str) -> Column:
    """Square of the largest distance between points of two boxes."""
    total = F.lit(0.0)
    for axis in "xyz":
        d = F.greatest(F.col(f"{a}{axis}1") - F.col(f"{b}{axis}0"), F.col(f"{b}{axis}1") - F.col(f"{a}{axis}0"))
        total = total + d * d
    return total


def _as(df: DataFrame, prefix: str, drop: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*(F.col(c).alias(prefix + c) for c in df.columns if c not in drop))


def near_pairs(df: DataFrame, id_col: str, lat: str, lon: str, radius_m: float) -> DataFrame:
    """All pairs of distinct ids at most ``radius_m`` apart along the great circle: ``id_a < id_b``.

    Rows without id or usable coordinates take no part; repeated rows count once; an id with several places is near
    whatever any of its places is near. An empty table gives no pairs. Extra columns are ignored.
    """
    radius = 1000.0 * EARTH_RADIUS_KM
    chord = 2 * radius * math.sin(min(radius_m / (2 * radius), math.pi / 2))
    far2, sure2 = (chord + SLACK_M) ** 2, max(0.0, chord - SLACK_M) ** 2
    levels = _levels(radius_m)
    last = levels[-1]

    points = usable_points(df, id_col, lat, lon)
    xyz = on_sphere(F.col("lat"), F.col("lon"), radius)
    points = points.select("id", "lat", "lon", *(c.alias(n) for n, c in zip("xyz", xyz)))
    cell = lambda c: F.least(F.lit((1 << last) - 1), F.floor((F.col(c) + radius) / (2 * radius) * (1 << last))).cast("long")
    points = cut_lineage(points.select("*", *(cell(c).alias(f"i{c}") for c in "xyz")))

    idx = [F.col("ix"), F.col("iy"), F.col("iz")]
    diagonal2 = sum((F.col(f"{c}1") - F.col(f"{c}0")) * (F.col(f"{c}1") - F.col(f"{c}0")) for c in "xyz")
    is_leaf = (F.col("n") <= LEAF_POINTS) | (diagonal2 <= sure2) | (F.col("level") == last)

    def path(some: list[int]) -> Column:
        above = lambda l: _key(levels[levels.index(l) - 1], last, *idx) if l != levels[0] else F.lit(-1).cast("long")
        return F.array(*(F.struct(F.lit(l).alias("level"), _key(l, last, *idx).alias("key"), above(l).alias("parent")) for l in some))

    def counted(rows: DataFrame, some: list[int]) -> DataFrame:
        boxes = (f(c).alias(c + k) for c in "xyz" for f, k in ((F.min, "0"), (F.max, "1")))
        nodes = rows.select(F.explode(path(some)).alias("p"), "x", "y", "z").groupBy("p.level", "p.key", "p.parent").agg(F.count(F.lit(1)).alias("n"), *boxes)
        return cut_lineage(nodes.withColumn("leaf", is_leaf))

    # The tree is built in two steps: below the middle level, only points of divided nodes are counted. Divided nodes, and
    # leaves below, are narrow tables: while they are small, their files' size lets the planner broadcast them, so that
    # neither nodes nor points are shuffled to be looked up.
    upper, lower = levels[:4], levels[4:]
    nodes = counted(points, upper)
    split_at = lambda df: cut_lineage(df.where(~F.col("leaf")).select(F.col("level").alias("up"), F.col("key").alias("parent")))
    divided = split_at(nodes)
    if lower:
        crowded = divided.where(F.col("up") == upper[-1]).select(F.col("parent").alias("_key"))
        deep = counted(points.withColumn("_key", _key(upper[-1], last, *idx)).join(crowded, "_key", "left_semi"), lower)
        nodes, divided = nodes.unionByName(deep), divided.unionByName(split_at(deep))
    up = F.element_at(F.create_map(*(F.lit(v) for j, l in enumerate(levels) for v in (l, levels[j - 1] if j else -1))), F.col("level"))
    nodes = nodes.withColumn("up", up)
    tree = cut_lineage(nodes.where(F.col("up") < 0).unionByName(nodes.join(divided, ["up", "parent"], "left_semi")).drop("up"))

    # The first level: pairs of neighbouring cells, found by key.
    step = [-1, 0, 1]
    top = tree.where(F.col("level") == levels[0])
    limit = (1 << levels[0]) - 1
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i in step for j in step for k in step))
    parts = [F.shiftright("a_key", 42), F.shiftright("a_key", 21).bitwiseAND((1 << 21) - 1), F.col("a_key").bitwiseAND((1 << 21) - 1)]
    near = _as(top, "a_", ("parent",)).withColumn("d", F.explode(around))
    moved = [p + F.col(f"d.{n}") for p, n in zip(parts, "ijk")]
    inside = moved[0].between(0, limit) & moved[1].between(0, limit) & moved[2].between(0, limit)
    near = near.where(inside).withColumn("b_key", F.shiftleft(moved[0], 42).bitwiseOR(F.shiftleft(moved[1], 21)).bitwiseOR(moved[2])).drop("d")
    pairs = near.join(_as(top, "b_", ("parent",)), "b_key").where((F.col("a_key") <= F.col("b_key")) & (_gap2("a_", "b_") <= far2))

    columns = ["level", "key", "n", *_BOX, "leaf"]
    ends: list[DataFrame] = []
    for j in range(len(levels)):
        pairs = cut_lineage(pairs.select(*(f"{s}_{c}" for s in "ab" for c in columns)))
        both = F.col("a_leaf") & F.col("b_leaf")
        ends.append(pairs.where(both))
        rest = pairs.where(~both)
        if j + 1 == len(levels) or rest.isEmpty():
            break
        # b is the divided node of the two; where both are, a is divided next.
        same = (F.col("a_level") == F.col("b_level")) & (F.col("a_key") == F.col("b_key"))
        swap = F.col("b_leaf")
        rest = rest.select(same.alias("same"), *(F.when(swap, F.col(f"{o}_{c}")).otherwise(F.col(f"{s}_{c}")).alias(f"{s}_{c}") for s, o in ("ab", "ba") for c in columns))
        child = tree.where(F.col("level") == levels[j + 1])
        rest = rest.select("same", *(f"a_{c}" for c in columns), F.col("b_key").alias("parent")).join(child, "parent")
        rest = rest.select("same", *(f"a_{c}" for c in columns), *(F.col(c).alias(f"b_{c}") for c in columns))
        # A leaf keeps its place: its join key matches nothing and spreads over the partitions.
        rest = rest.withColumn("parent", F.when(F.col("a_leaf"), -2 - F.abs(F.hash("a_key", "b_key").cast("long"))).otherwise(F.col("a_key")))
        rest = rest.join(child.select("parent", *(F.col(c).alias(f"c_{c}") for c in columns)), "parent", "left")
        rest = rest.select("same", *(F.coalesce(F.col(f"c_{c}"), F.col(f"a_{c}")).alias(f"a_{c}") for c in columns), *(f"b_{c}" for c in columns))
        pairs = rest.where((_gap2("a_", "b_") <= far2) & (~F.col("same") | (F.col("a_key") <= F.col("b_key"))))

    joined = ends[0]
    for e in ends[1:]:
        joined = joined.unionByName(e)
    one = ((F.col("a_level") == F.col("b_level")) & (F.col("a_key") == F.col("b_key"))).alias("one")
    joined = joined.select("a_level", "a_key", "b_level", "b_key", "a_n", "b_n", one, (_reach2("a_", "b_") <= sure2).alias("sure"))
    chunks = lambda n: F.ceil(F.col(n) / F.lit(CHUNK)).cast("int")
    joined = joined.withColumn("a_salt", F.explode(F.sequence(F.lit(0), chunks("a_n") - 1))).withColumn("b_salt", F.explode(F.sequence(F.lit(0), chunks("b_n") - 1)))
    # Two chunks of one leaf meet once.
    joined = joined.where(~F.col("one") | (F.col("a_salt") <= F.col("b_salt")))

    leaves = cut_lineage(tree.where("leaf").select("level", "key", "n"))
    placed = points.select("id", "lat", "lon", F.explode(F.transform(path(levels), lambda p: F.struct(p["level"].alias("level"), p["key"].alias("key")))).alias("p"))
    placed = placed.select("id", "lat", "lon", "p.level", "p.key").join(leaves, ["level", "key"])
    placed = cut_lineage(placed.select("level", "key", F.pmod(F.xxhash64("id"), chunks("n")).cast("int").alias("salt"), "id", "lat", "lon"))

    found = joined.join(_as(placed, "a_"), ["a_level", "a_key", "a_salt"]).join(_as(placed, "b_"), ["b_level", "b_key", "b_salt"])
    found = found.where(F.col("sure") | (haversine_km(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")) * 1000 <= radius_m))
    twice = F.col("one") & (F.col("a_salt") == F.col("b_salt")) & (F.col("a_id") > F.col("b_id"))
    found = found.where((F.col("a_id") != F.col("b_id")) & ~twice)
    return found.select(F.least("a_id", "b_id").alias("id_a"), F.greatest("a_id", "b_id").alias("id_b")).distinct()
