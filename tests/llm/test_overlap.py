import random

import pytest

from quern.llm import overlap
from quern.plans import skew

CYR = "абвгдеклмнопрст"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def matches(a, b):
    return sorted(a.split()) == sorted(b.split()) or distance(a, b) <= 2


def edited(r, t):
    for _ in range(r.randint(0, 3)):
        k, c = r.randrange(len(t) + 1), r.choice(CYR + " ")
        t = r.choice([t[:k] + c + t[k:], t[:k] + t[k + 1 :], t[:k] + c + t[k + 1 :]])
    return " ".join(t.split())


@pytest.mark.parametrize("share", [skew.HOT_SHARE, 0.0])
def test_no_match_is_lost(spark, monkeypatch, share):
    # Without a share, every list of more than three entries is cut into chunks.
    monkeypatch.setattr(skew, "HOT_SHARE", share)
    monkeypatch.setattr(overlap, "HOT_LIST", 4096 if share else 3)
    r = random.Random(5)
    base = ["".join(r.choice(CYR) for _ in range(r.randint(1, 4))) for _ in range(40)]
    base += [" ".join("".join(r.choice(CYR) for _ in range(r.randint(1, 9))) for _ in range(r.randint(1, 6))) for _ in range(120)]
    base += ["ремонт окон для офиса срочно", "ремонт окон на дому", "а б в г д е ж", "аа"]
    left = {t for t in base if t}
    right = {t for b in base for t in (edited(r, b), " ".join(r.sample(b.split(), len(b.split()))), edited(r, b)) if t} | {"б а", "в г д е ж а б"}
    frame = lambda x: spark.createDataFrame([(t,) for t in x] + [(None,), ("",)], "text string")
    got = [(x["text_a"], x["text_b"]) for x in overlap.matching_texts(frame(left), frame(right)).collect()]
    brute = {(a, b) for a in left for b in right if matches(a, b)}
    assert len(got) == len(set(got)) and set(got) == brute and len(brute) > 200


def test_pairs_far_from_a_match_end_where_they_meet(spark, monkeypatch):
    # All texts share a long word, so that every pair meets under its terms; only repeated texts match.
    r = random.Random(3)
    word = lambda: "".join(r.choice(CYR) for _ in range(12))
    texts = [f"водонагреватель {word()} {word()}" for _ in range(150)]
    met, join = [], overlap._met
    monkeypatch.setattr(overlap, "_met", lambda a, b: met.append(join(a, b)) or met[0])
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    assert overlap.matching_texts(frame, frame).count() == len(texts)
    assert met[0].select("id_a", "id_b").distinct().count() < 2 * len(texts)


def test_edits_flip_few_bits_of_the_sketches():
    r = random.Random(4)
    for _ in range(3000):
        t = u = " ".join("".join(r.choice(CYR + "ab19") for _ in range(r.randint(1, 7))) for _ in range(r.randint(1, 5)))
        for _ in range(overlap.EDITS):
            k, c = r.randrange(len(u) + 1), r.choice(CYR + " ")
            u = r.choice([u[:k] + c + u[k:], u[:k] + u[k + 1 :], u[:k] + c + u[k + 1 :]])
        flips = [(x ^ y).bit_count() if x ^ y >= 0 else 64 - (~(x ^ y)).bit_count() for x, y in zip(overlap._sketches(t), overlap._sketches(u))]
        assert flips[0] <= overlap.LETTER_BITS and flips[1] <= overlap.BIGRAM_BITS
        assert overlap._sketches(t) == overlap._sketches(" ".join(r.sample(t.split(), len(t.split()))))


def test_pairs_and_report(spark):
    q = spark.createDataFrame(
        [("q1", "Ремонт ОКОН", None, "test", "app"), ("q1", "Ремонт ОКОН", None, "test", "app"), ("q2", None, "окон ремонт!", "test", None), ("q3", "ремонт окан", "", "validation", "app"), ("q4", "!!!", None, "validation", "app"), (None, "ремонт окон", None, "test", "app"), ("q5", "x" * 4000, None, "validation", "app")],
        "query_id string, search_query string, search_infm_params_text string, eval_split string, source string",
    )
    t = spark.createDataFrame([(1, "ремонт окон", "a"), (1, "ремонт окон", "a"), (2, "Ремонт, окон", "b"), (3, None, "c"), (4, "другое слово", "d"), (None, "ремонт окон", "e"), (5, "x" * 3999, "f")], "interaction_id long, search_query string, text string")
    got = {tuple(x) for x in overlap.cross_split_pairs(q, t).collect()}
    assert got == {(a, b) for a in ("q1", "q2", "q3") for b in (1, 2)} | {("q5", 5)}
    report = {(x["eval_split"], x["source"]): (x["n_queries"], x["n_overlapping"], x["n_exact"], x["n_interactions"]) for x in overlap.overlap_report(q, t).collect()}
    assert report == {("test", "app"): (1, 1, 1, 2), ("test", None): (1, 1, 1, 2), ("validation", "app"): (3, 2, 0, 3)}
    assert overlap.cross_split_pairs(q.limit(0), t).count() == 0 and overlap.cross_split_pairs(q, t.limit(0)).count() == 0
