import base64
import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import tokenizer as T

PATH = f"{T.FOLDER}/{T.VOCABULARY}"
SPECIAL = ["", " ", "\n\n  x", "I'll don't we've", "ёлка Ёлка елка", "🙂🙂", "е́", "​", "<|endoftext|>", "123456789", " ", "\t\t", "ﬁ"]


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    return tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_special_and_long_texts(reference):
    e = T.encoder(PATH)
    for t in [*SPECIAL, "а" * 5000, "ab" * 4000, "1" * 3000, " " * 3000]:
        ids = e.encode(t)
        assert ids == reference.encode_ordinary(t) and e.decode(ids) == t


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(t):
    e = T.encoder(PATH)
    t = t.encode("utf-8", "ignore").decode()
    ids = e.encode(t)
    assert e.decode(ids) == t
    assert ids == [e.rank[p] for piece in e.split(t) for p in e.merge(piece.encode())]


def test_memo_may_start_anew(reference, monkeypatch):
    monkeypatch.setattr(T, "MEMO", 3)
    e = T.BacktrackingEncoder(PATH)
    r = random.Random(1)
    for _ in range(60):
        t = " ".join("".join(r.choice("абвгabc") for _ in range(6)) for _ in range(5))
        assert e.encode(t) == reference.encode_ordinary(t)


def test_frames(spark, reference):
    rows = [(1, "Привет, мир"), (2, None), (3, ""), (3, "два раза")]
    df = spark.createDataFrame(rows, "ids long, text string")
    got = {(x["ids"], x["n"]): x for x in T.token_counts(df, ["ids"], "text").withColumnRenamed("n_tokens", "n").collect()}
    assert {k for k in got} == {(i, len(reference.encode_ordinary(t or ""))) for i, t in rows}
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    ids = T.token_ids(frame, ["doc_id"], "text")
    assert sorted((x["doc_id"], x["ids"]) for x in ids.collect()) == sorted((i, reference.encode_ordinary(t or "")) for i, t in rows)
    assert sorted(x["text"] for x in T.decoded(ids, ["doc_id"]).collect()) == sorted(t or "" for _, t in rows)
    assert T.token_ids(frame.limit(0), ["doc_id"], "text").count() == 0
