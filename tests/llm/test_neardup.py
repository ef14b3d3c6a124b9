import random

import pytest

from quern.llm import neardup
from quern.llm.components import connected_components

TEXTS = ["a", "b", "c"]
SCHEMA = "id string, a string, b string, c string, words string"


def rows_of(r):
    vocabulary = [f"слово{k}" for k in range(400)] + list("абвгде")
    rows = []
    for k in range(60):
        w = r.sample(vocabulary, r.choice([20, 24, 25, 26, 30, 40, 60, 110]))
        for v in range(4):
            x = list(w)
            for _ in range(r.randint(0, len(w) // 4)):
                x[r.randrange(len(x))] = r.choice(vocabulary)
            if r.random() < 0.3:
                x += r.sample(vocabulary, len(x) // 5)
            r.shuffle(x)
            rows.append((f"{k:03}-{v}", " ".join(x[:5]), ", ".join(x[5:20]).upper(), " ".join(x[20:]) or None, "clash"))
    rows += [(f"dup{k}", *rows[30][1:]) for k in range(5)] + [rows[31], rows[31], (None, *rows[31][1:]), ("nulls", None, None, None, None)]
    rows.append(("long", " ".join(vocabulary), " ".join(f"t{k}" for k in range(6000)), None, None))
    return rows


def sets(rows):
    return {(r[0], frozenset(" ".join(x or "" for x in r[1:4]).lower().replace(",", " ").split())) for r in rows if r[0]}


@pytest.mark.parametrize(("shared", "part"), [(4096, 1_000_000), (20, 300), (1, 20_000), (0.001, 1000)])
def test_pairs_match_brute_force(spark, monkeypatch, shared, part):
    # The fewer records may share a chain, the longer chains are; the less a part takes, the more buckets are hot.
    monkeypatch.setattr(neardup, "SHARED", shared)
    monkeypatch.setattr(neardup, "PART", part)
    rows = rows_of(random.Random(8))
    got = [tuple(x) for x in neardup.similar_pairs(spark.createDataFrame(rows, SCHEMA), "id", TEXTS).collect()]
    s = [(i, w) for i, w in sets(rows) if len(w) >= 25]
    brute = {(a, b) for a, x in s for b, y in s if a < b and len(x & y) * 10 >= len(x | y) * 7}
    assert len(got) == len(set(got)) and set(got) == brute and len(brute) > 100


def test_groups(spark):
    rows = rows_of(random.Random(9))
    df = spark.createDataFrame(rows, SCHEMA)
    pairs = [tuple(x) for x in neardup.similar_pairs(df, "id", TEXTS).collect()]
    root = {i: i for i, w in sets(rows) if len(w) >= 25}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {(x["id"], x["group_id"]) for x in neardup.similar_groups(df, "id", TEXTS).collect()}
    assert got == {(i, find(i)) for i in root}


def test_empty(spark):
    assert neardup.similar_pairs(spark.createDataFrame([], SCHEMA), "id", TEXTS).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 102)], "a long, b long")
    got = {x["node"]: x["label"] for x in connected_components(links).collect()}
    assert all(got[k] == 0 for k in range(41)) and got[102] == 100


def test_a_crowd_of_near_copies(spark, monkeypatch):
    # Their common chains fill one key bucket, whose classes are divided into chunks.
    monkeypatch.setattr(neardup, "PART", 120)
    r = random.Random(3)
    base = [f"слово{k}" for k in range(40)]
    rows = []
    for k in range(150):
        x = list(base)
        for _ in range(r.randint(0, 6)):
            x[r.randrange(40)] = f"иное{r.randrange(30)}"
        rows.append((f"{k:03}", " ".join(x), None, None, None))
    got = [tuple(x) for x in neardup.similar_pairs(spark.createDataFrame(rows, SCHEMA), "id", TEXTS).collect()]
    s = list(sets(rows))
    brute = {(a, b) for a, x in s for b, y in s if a < b and len(x & y) * 10 >= len(x | y) * 7}
    assert len(got) == len(set(got)) and set(got) == brute and len(brute) > 3000
