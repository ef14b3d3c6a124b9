import math
import random
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import packing


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 40), st.data())
def test_blocks_hold_every_item_within_capacity(capacity, data):
    sizes = np.array(data.draw(st.lists(st.integers(1, capacity), max_size=60)), dtype="int64")
    pack, n = packing.pack_block(sizes, capacity)
    used = np.bincount(pack, sizes, minlength=n) if n else np.zeros(0)
    assert len(used) == n and (used <= capacity).all() and (used > 0).all()
    assert n <= math.ceil(1.7 * max(1, math.ceil(sizes.sum() / capacity)))


def test_large_items_are_matched():
    pack, n = packing.pack_block(np.array([60, 40, 55, 45, 50, 50, 34, 33]), 100)
    assert n == 4 and pack[0] == pack[1] and pack[2] == pack[3] and pack[4] == pack[5] and pack[6] == pack[7]


def test_frame(spark):
    r = random.Random(2)
    rows = [(k, r.choice([1, 5, 30, 90, 100, 101, 250, 0, None, r.randint(1, 100)])) for k in range(900)] + [(7, 30), (7, 30)]
    df = spark.createDataFrame([(i, n, "x", "y") for i, n in rows], "doc_id long, n_tokens long, pack string, block string")
    caps = spark.createDataFrame([("small", 100), ("large", 1000), ("bad", 0), ("none", None)], "pack_name string, capacity_tokens long")
    out = packing.pack_items(df, caps).collect()
    for name, c in (("small", 100), ("large", 1000)):
        used, pieces = defaultdict(int), defaultdict(list)
        for x in out:
            if x["pack_name"] == name:
                pieces[x["doc_id"]].append(x)
                if x["pack"] is not None:
                    used[x["block"], x["pack"]] += x["n_tokens"]
        assert max(used.values()) <= c
        for i in {i for i, _ in rows}:
            own = sorted((x["n_tokens"] for x in pieces[i]), reverse=True)
            want = sorted((s for j, n in rows if j == i for s in ([c] * ((n or 0) // c) + ([(n or 0) % c] if (n or 0) % c or not n else []))), reverse=True)
            assert own == want
        total = sum(n or 0 for _, n in rows)
        assert len(used) <= math.ceil(total / c * 1.02) + 1
    assert {x["pack_name"] for x in out} == {"small", "large"}
    assert all((x["pack"] is None) == (x["n_tokens"] == 0) for x in out)
    assert packing.pack_items(df.limit(0), caps).count() == 0 and packing.pack_items(df, caps.limit(0)).count() == 0
    report = {x["pack_name"]: x for x in packing.fill_report(packing.pack_items(df, caps), caps).collect()}
    assert report["large"]["filled"] > 0.95
