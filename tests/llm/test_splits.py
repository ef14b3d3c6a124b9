import random
import unicodedata
from collections import Counter, defaultdict

import pytest

from quern.llm import splits
from quern.plans import skew

RAW = ["search_query", "search_infm_params_text", "search_category"]
SCHEMA = "interaction_id long, search_query string, search_infm_params_text string, search_category long"
SHAPES = str.maketrans("ёaceopxy", "еасеорху")


def words(t):
    out, w = [], ""
    for c in (t or "").lower().translate(SHAPES) + " ":
        if unicodedata.category(c)[0] in "LN":
            w += c
        elif w:
            out.append(w)
            w = ""
    return tuple(sorted(out))


def table(spark):
    r = random.Random(4)
    rows = [(k, "Ремонт окон", None, 1) for k in range(300)]
    forms = ["ремонт ОКОН!", "окон, ремонт", "Pемонт  окон", "ремонт окон окон", None, "", "ёлка", "елка"]
    rows += [(1000 + k, r.choice(forms), r.choice([None, "", "Тип 1", "1 тип"]), r.choice([0, 1, None])) for k in range(120)]
    rows += [(2000 + k, f"слово{k}", "x" * 3000 if k == 7 else None, k % 5) for k in range(700)]
    return rows + rows[290:310]


@pytest.mark.parametrize("share", [skew.HOT_SHARE, 0.0])
def test_pairs_match_brute_force(spark, monkeypatch, share):
    monkeypatch.setattr(skew, "HOT_SHARE", share)
    monkeypatch.setattr(splits, "CROWD", 2048 if share else 3)
    rows = table(spark)
    df = spark.createDataFrame(rows, SCHEMA)
    plan = spark.createDataFrame([("train", 80), ("validation", 10), ("test", 10)], "split_name string, share_percent long")
    done = splits.assign_splits(splits.search_components(df), plan)
    got = {tuple(x) for x in splits.variant_pairs(done, "interaction_id", RAW).collect()}
    groups = defaultdict(set)
    for i, q, p, c in rows:
        groups[c, words(q), words(p)].add((i, q, p))
    brute = {(a[0], b[0]) for g in groups.values() for a in g for b in g if a[0] < b[0] and a[1:] != b[1:]}
    assert got == brute and len(got) > 500


@pytest.mark.parametrize("fan", [2, 64])
def test_splits_keep_components_and_shares(spark, monkeypatch, fan):
    # With two blocks a task, the blocks' bins are combined in several rounds.
    monkeypatch.setattr(splits, "FAN", fan)
    rows = table(spark)
    plan = spark.createDataFrame([("train", 80), ("validation", 10), ("test", 10), ("none", 0)], "split_name string, share_percent long")
    df = splits.search_components(spark.createDataFrame(rows, SCHEMA))
    one = splits.assign_splits(df, plan, block=100).collect()
    assert len(one) == len(rows)
    by = defaultdict(set)
    for x in one:
        by[x["component"]].add(x["split_name"])
    assert all(len(s) == 1 for s in by.values())
    share = Counter(x["split_name"] for x in one)
    assert abs(share["train"] / len(one) - 0.8) < 0.02 and abs(share["test"] / len(one) - 0.1) < 0.02 and "none" not in share
    again = splits.assign_splits(df, plan, block=100).collect()
    assert sorted((x["interaction_id"], x["split_name"]) for x in one) == sorted((x["interaction_id"], x["split_name"]) for x in again)
    assert splits.assign_splits(df.limit(0), plan).count() == 0


def test_largest_differencing_balances():
    r = random.Random(1)
    weights = [r.randint(1, 60) for _ in range(400)]
    bins = splits.largest_differencing([[(w, k)] for k, w in enumerate(weights)], 10)
    assert len(bins) == 10 and max(w for w, _ in bins) - min(w for w, _ in bins) <= 2
    members = [k for _, t in bins for k in splits._members(t)]
    assert sorted(members) == list(range(400))
    assert all(sum(weights[k] for k in splits._members(t)) == w for w, t in bins)
    assert splits.largest_differencing([], 5) == []
