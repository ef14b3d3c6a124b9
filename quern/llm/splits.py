"""Splits that keep related records together.

Records of one component (here: one search, however it was typed) get one split. Components are divided into many equal
bins by the largest-differencing method: every partial solution is a tuple of bin sums; the two with the largest spread
are combined repeatedly, the heaviest bins of one with the lightest of the other. Blocks of components are solved side by
side, and the blocks' tuples, ``BINS`` numbers each, are combined by the same method, a few blocks a task and round, until
one is left. Whole bins are then allotted to the splits, heaviest first, each to the split that is furthest below its share.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.text import same_shape_words
from quern.plans.lineage import cut_lineage
from quern.plans.skew import attach_members, join_weighted, self_pairs

#: Bins; a multiple of 100 fits whole percentages.
BINS = 200
#: Components that one task divides; more blocks are made as the number of components grows.
BLOCK = 50_000
#: Blocks whose bins one task combines in a round.
FAN = 64
#: Variants of one component that one task pairs, if they are more than a thousandth of all.
CROWD = 2048


def largest_differencing(solutions: list[list[tuple[float, object]]], bins: int) -> list[tuple[float, object]]:
    """Combines partial solutions (lists of (weight, members), heaviest first, at most ``bins`` long) into one.

    ``members`` are nested pairs, so that combining two bins takes constant time. Ties go to the earlier solution.
    """
    spread = lambda s: s[0][0] - (s[-1][0] if len(s) == bins else 0)
    heap = [(-spread(s), i, s) for i, s in enumerate(solutions) if s]
    heapq.heapify(heap)
    number = len(solutions)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        shared = max(0, len(a) + len(b) - bins)
        # The heaviest of a stay alone or meet the lightest of b, and the other way round.
        merged = a[: len(a) - shared] + b[: len(b) - shared]
        for x, y in zip(a[len(a) - shared :], reversed(b[len(b) - shared :])):
            merged.append((x[0] + y[0], (x[1], y[1])))
        merged.sort(key=lambda m: -m[0])
        heapq.heappush(heap, (-spread(merged), number, merged))
        number += 1
    return heap[0][2] if heap else []


def _members(tree: object) -> Iterator[object]:
    stack = [tree]
    while stack:
        top = stack.pop()
        if type(top) is tuple:
            stack.extend(top)
        else:
            yield top


def search_components(df: DataFrame) -> DataFrame:
    """Adds ``component``: equal for rows with equal search_category (null equals null) and the same words the same
    number of times in search_query and in search_infm_params_text; letter case, order, punctuation, ё/е and Latin
    look-alikes don't matter and null is empty. A digest of 128 bits stands for the words."""
    bag = lambda c: F.array_join(F.array_sort(same_shape_words(F.col(c))), " ")
    whole = F.concat_ws("\u0001", F.coalesce(F.col("search_category").cast("string"), F.lit("")), bag("search_query"), bag("search_infm_params_text"))
    return df.withColumn("component", F.md5(whole))


def assign_splits(rows: DataFrame, plan: DataFrame, component: str = "component", bins: int = BINS, block: int = BLOCK) -> DataFrame:
    """Adds ``split_name`` to every row: equal for equal ``component``, shares as in ``plan`` (split_name, share_percent).

    A null component is one of its own. Splits with no share get nothing; an empty table gives no rows. Shares are met
    up to half a bin, unless one component alone outweighs its split. The same table gives the same splits.
    """
    rows = rows.withColumn(component, F.coalesce(component, F.lit("")))
    weights = cut_lineage(rows.groupBy(component).agg(F.count(F.lit(1)).alias("_weight")))
    n_components, total = weights.agg(F.count(F.lit(1)), F.coalesce(F.sum("_weight"), F.lit(0))).first()
    blocks = max(1, -(-n_components // block))

    def divide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_weight", "_c"], ascending=[False, True], kind="stable")
        solved = largest_differencing([[(w, k)] for k, w in enumerate(pdf["_weight"].tolist())], bins)
        at = [0] * len(pdf)
        for n, (_, tree) in enumerate(solved):
            for k in _members(tree):
                at[k] = n
        return pd.DataFrame({"_c": pdf["_c"], "_weight": pdf["_weight"], "_block": pdf["_block"], "_local": at})

    keyed = weights.select(F.col(component).alias("_c"), "_weight", F.pmod(F.xxhash64(component), F.lit(blocks)).alias("_block"))
    local = cut_lineage(keyed.groupBy("_block").applyInPandas(divide, "_c string, _weight long, _block long, _local int"))

    # Blocks' tuples are combined in rounds, so no task holds more than FAN of them.
    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_block", "_w", "_local"], ascending=[True, False, True], kind="stable").reset_index(drop=True)
        parts = [[(w, k) for k, w in zip(g.index.tolist(), g["_w"].tolist())] for _, g in pdf.groupby("_block", sort=True)]
        at, weight = [0] * len(pdf), [0] * len(pdf)
        for n, (w, tree) in enumerate(largest_differencing(parts, bins)):
            for k in _members(tree):
                at[k], weight[k] = n, w
        return pd.DataFrame({"_block": pdf["_block"], "_local": pdf["_local"], "_up": pdf["_up"], "_at": at, "_sum": weight})

    sums = cut_lineage(local.groupBy("_block", "_local").agg(F.sum("_weight").alias("_w")))
    steps = []
    while blocks > 1:
        blocks = -(-blocks // FAN)
        step = cut_lineage(sums.withColumn("_up", F.floor(F.col("_block") / FAN)).groupBy("_up").applyInPandas(combine, "_block long, _local int, _up long, _at int, _sum long"))
        steps.append(step)
        sums = step.groupBy(F.col("_up").alias("_block"), F.col("_at").alias("_local")).agg(F.first("_sum").alias("_w"))

    # At most ``bins`` rows and the rows of the plan are left.
    names = [(r["split_name"], float(r["share_percent"] or 0)) for r in plan.orderBy("split_name").collect()]
    names = [(n, s) for n, s in names if s > 0]
    if not names:
        raise ValueError("the plan gives no split a share")
    wanted = [s / sum(s for _, s in names) * total for _, s in names]
    chosen = []
    for r in sorted(sums.collect(), key=lambda r: (-r["_w"], r["_local"])):
        to = max(range(len(names)), key=lambda i: wanted[i])
        wanted[to] -= r["_w"]
        chosen.append((r["_block"], r["_local"], names[to][0]))
    table = rows.sparkSession.createDataFrame(chosen, "_block long, _local int, split_name string")
    for step in reversed(steps):
        table = step.select("_block", "_local", F.col("_up").alias("u"), F.col("_at").alias("a")).join(table.select(F.col("_block").alias("u"), F.col("_local").alias("a"), "split_name"), ["u", "a"]).drop("u", "a")
    chosen = local.join(table, ["_block", "_local"]).select(F.col("_c").alias(component), "_weight", "split_name")
    return join_weighted(rows, chosen, component, "_weight", total)


def variant_pairs(assigned: DataFrame, id_col: str, raw: list[str], component: str = "component", split: str = "split_name") -> DataFrame:
    """Pairs ``<id>_a < <id>_b`` of distinct ids in one component and split whose raw columns differ (null differs from empty).

    Raw variants of a component are paired first, in chunks where it has many; ids are attached afterwards, in salted chunks
    where a variant has many, so the work follows the result and no task takes a whole component. Digests of 128 bits stand
    for component and variant.
    """
    digest = F.md5(F.concat_ws("\u0001", *(F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in raw)))
    variant = F.md5(F.concat_ws("\u0001", F.col(component), F.col(split), digest))
    ids = cut_lineage(assigned.where(F.col(id_col).isNotNull()).select(F.md5(F.concat_ws("\u0001", component, split)).alias("key"), variant.alias("variant"), F.col(id_col).alias("id")).distinct())
    pairs = self_pairs(cut_lineage(ids.select("key", "variant").distinct()), "key", "variant", CROWD).select("variant_a", "variant_b")
    for s in "ab":
        pairs = attach_members(pairs, ids.select(F.col("variant").alias(f"variant_{s}"), "id"), f"variant_{s}", f"id_{s}")
    found = pairs.where(F.col("id_a") != F.col("id_b"))
    return found.select(F.least("id_a", "id_b").alias(f"{id_col}_a"), F.greatest("id_a", "id_b").alias(f"{id_col}_b")).distinct()
