"""Micro-tables for the semantic traps of the ranking operators."""

import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.config import SCORES, SIGNALS, GeneratorConfig
from quern.functions.encoder import model_encoder
from quern.functions.text import full_text, lemmatize, tokens
from quern.functions.vectors import dot, hash_embedding, l2_normalize, mean_vectors
from quern.operators import blocks, fusion
from quern.operators import candidates as C
from quern.operators import evaluate as V
from quern.operators import explore as X
from quern.operators import labels as L
from quern.operators import rerank as R
from quern.operators import signals as S
from quern.operators import submission as U
from quern.operators.features import feature_table, features_by_priority, item_content_features
from quern.operators.fusion import average_rank, fused_score, top_by, with_rank_terms
from quern.sources import tables as T


def test_tokens(spark):
    rows = [("Уборка квартиры, Ёлка-2 в Iphone 15",), (None,), ("",), ("и в не",), ("Café olé",), ("б б Бб",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(tokens(F.col("t"))).collect()]
    assert got == [["уборка", "квартиры", "ёлка", "iphone", "15"], [], [], [], ["caf", "ol"], ["бб"]]


def test_lemmas_are_filtered_after_the_dictionary(spark):
    df = spark.createDataFrame([(1, ["уборки", "шло", "iphone", "уборки", "была", "вам"]), (2, [])], "i long, ts array<string>")
    lemmas = spark.createDataFrame([("уборки", "уборка"), ("шло", "и"), ("iphone", "x"), ("был", "быт"), ("была", "быт"), ("вам", "ваш")], "token string, lemma string")
    # A stopword's lemma is a stopword, too.
    assert {r["i"]: r["ts"] for r in lemmatize(df, "ts", lemmas).collect()} == {1: ["уборка", "iphone", "уборка"], 2: []}


def test_full_text_keeps_the_space(spark):
    df = spark.createDataFrame([(None, "b"), ("a", None)], "a string, b string")
    assert [r[0] for r in df.select(full_text(F.col("a"), F.col("b"))).collect()] == [" b", "a "]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    got = [r[0] for r in df.select(l2_normalize(F.col("v"))).collect()]
    assert got[0] == pytest.approx([0.6, 0.8]) and got[1] == [0.0, 0.0]
    m = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (None, [2.0, 0.0]), (1, None)], "k long, v array<float>")
    got = {r["k"]: (list(r["centroid"]), r["n"]) for r in mean_vectors(m, "k", "v").collect()}
    assert got[1][0] == pytest.approx([math.sqrt(0.5)] * 2) and got[1][1] == 2 and got[None][0] == [1.0, 0.0]
    h = hash_embedding(spark.createDataFrame([(1, ["a", "b"]), (2, [])], "i long, ts array<string>"), "i", "ts")
    norms = {r["i"]: r["n"] for r in h.select("i", dot(F.col("embedding"), F.col("embedding")).alias("n")).collect()}
    assert norms[1] == pytest.approx(1.0) and norms[2] == 0.0


@pytest.mark.parametrize("size", [3, 10_000])
def test_coverage_by_meaning_needs_no_table_of_matches(spark, monkeypatch, size):
    monkeypatch.setattr(blocks, "ITEM_BLOCK", size)
    monkeypatch.setattr(blocks, "COVERAGE_QUERIES", size)
    r = random.Random(6)
    some = lambda n: r.sample("abcdefghij", n)
    q = spark.createDataFrame([(f"q{k}", some(r.randrange(4))) for k in range(30)], "query_id string, qt array<string>")
    rows = [(f"i{k % 50}", some(r.randrange(5))) for k in range(60)]
    i = spark.createDataFrame(rows, "item_id string, it array<string>")
    v = spark.createDataFrame([(t, [r.uniform(-1, 1) for _ in range(4)]) for t in "abcdefg"] + [("h", None)], "token string, embedding array<float>")
    e = spark.createDataFrame([(f"i{k}", [r.uniform(-1, 1) for _ in range(4)] if k % 7 else None) for k in range(48)], "item_id string, embedding array<float>")
    table = S.semantic_matches(v, e, "item_id", 0.3)
    want = {x["query_id"]: (x["n_items"], x["best"], round(x["total"], 6)) for x in S.coverage_summary(q, i, "query_id", "item_id", "qt", "it", table).collect()}
    got = {x["query_id"]: (x["n_items"], x["best"], round(x["total"], 6)) for x in S.coverage_summary(q, i, "query_id", "item_id", "qt", "it", near=(v, e, 0.3)).collect()}
    plain = {x["query_id"]: x["n_items"] for x in S.coverage_summary(q, i, "query_id", "item_id", "qt", "it").collect()}
    assert got == want and any(got[k][0] > plain.get(k, 0) for k in got)


def test_coverage_moves_items_as_blocks(spark, monkeypatch):
    """Many queries don't repeat the items: 3000 of them, 24 blocks of queries before, meet each block of items once."""
    made = []
    run = blocks.cut_lineage
    monkeypatch.setattr(blocks, "cut_lineage", lambda df: made.append(run(df)) or made[-1])
    q = spark.createDataFrame([(f"q{k}", ["a", "b"]) for k in range(3000)], "query_id string, ts array<string>")
    i = spark.createDataFrame([(["a", f"t{k}"],) for k in range(40)], "ts array<string>").repartition(2)
    got = blocks.coverage_totals(q, i, "query_id")
    assert made[0].columns == ["ib", "block"] and made[0].count() == 2
    assert {tuple(x)[1:] for x in got.collect()} == {(40, 0.5, 20.0)} and got.count() == 3000


def test_coverage_counts_unknown_tokens_in_the_denominator(spark):
    df = spark.createDataFrame([(["a", "zz"], ["a", "b"]), ([], ["a"]), (["a"], [])], "q array<string>, i array<string>")
    assert [r[0] for r in df.select(S.coverage(F.col("q"), F.col("i"))).collect()] == [0.5, 0.0, 0.0]
    q = spark.createDataFrame([("q", ["a", "zz"])], "query_id string, qt array<string>")
    i = spark.createDataFrame([("i", ["a", "b"]), ("j", ["c"])], "item_id string, it array<string>")
    sem = spark.createDataFrame([("zz", "j"), ("a", "i")], "token string, item_id string")
    assert [tuple(r) for r in S.sparse_coverage(q, i, "query_id", "item_id", "qt", "it").collect()] == [("q", "i", 0.5)]
    assert {tuple(r) for r in S.sparse_coverage(q, i, "query_id", "item_id", "qt", "it", sem).collect()} == {("q", "i", 0.5), ("q", "j", 0.5)}
    assert [tuple(r) for r in S.coverage_summary(q, i, "query_id", "item_id", "qt", "it", sem).collect()] == [("q", 2, 0.5, 1.0)]
    r = random.Random(5)
    some = lambda n: r.sample("abcdefgh", n)
    q = spark.createDataFrame([(f"q{k}", some(r.randrange(4))) for k in range(30)], "query_id string, qt array<string>")
    i = spark.createDataFrame([(f"i{k}", some(r.randrange(5))) for k in range(60)], "item_id string, it array<string>")
    pairs = S.sparse_coverage(q, i, "query_id", "item_id", "qt", "it")
    want = {x["query_id"]: (x["n"], x["b"], round(x["t"], 6)) for x in pairs.groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("b"), F.sum("score").alias("t")).collect()}
    got = {x["query_id"]: (x["n_items"], x["best"], round(x["total"], 6)) for x in S.coverage_summary(q, i, "query_id", "item_id", "qt", "it").collect()}
    assert got == want


def test_semantic_threshold_is_compared_as_float(spark):
    v = spark.createDataFrame([("t", [1.0, 0.0])], "token string, embedding array<float>")
    i = spark.createDataFrame([("i", [0.82, 0.0]), ("j", [0.81, 0.0]), ("k", None)], "item_id string, embedding array<float>")
    assert [tuple(r) for r in S.semantic_matches(v, i, "item_id", 0.82).collect()] == [("t", "i")]


def test_location_branches(spark):
    rows = [(1, 1.0, 2.0, 1, None, None), (1, 1.0, 2.0, 2, None, 3.0), (9, None, None, 2, 1.0, 1.0), (9, None, None, 9, 1.0, 1.0), (1, 0.0, 0.0, 2, 0.0, 5.0), (1, 0.0, 0.0, 2, 0.0, 0.01)]
    df = spark.createDataFrame(rows, "q long, cla double, clo double, i long, la double, lo double")
    place = [F.col(c) for c in ("q", "cla", "clo", "i", "la", "lo")]
    got = df.select(S.location_match(*place).alias("s"), S.location_distance_km(*place).alias("d")).collect()
    assert [r["s"] for r in got[:5]] == [1.0, 0.0, 0.0, 1.0, 0.0]
    assert [r["d"] for r in got[:4]] == [0.0, None, None, 0.0]
    assert got[4]["d"] > 520 and 0 < got[5]["s"] < 1


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 4), min_size=1, max_size=12))
def test_average_ranks_sum_up(spark, values):
    df = spark.createDataFrame([("q", f"i{k}", float(v)) for k, v in enumerate(values)], "query_id string, item_id string, s float")
    ranks = [r[0] for r in df.select(average_rank("query_id", "s")).collect()]
    n = len(values)
    assert sum(ranks) == n * (n + 1) / 2
    brute = sorted(sum(x > v for x in values) + (sum(x == v for x in values) + 1) / 2 for v in values)
    assert sorted(ranks) == brute


def test_fusion_skips_constant_and_weightless_signals(spark):
    rows = [("q", "a", 1.0, 5.0), ("q", "b", 1.0, 4.0), ("q", "c", 1.0, 4.0), ("r", "a", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "query_id string, item_id string, x float, y float")
    f = with_rank_terms(df, "query_id", "item_id", ["x", "y"]).withColumn("f", fused_score(["x", "y"], [1.0, 1.0]))
    got = {(r["query_id"], r["item_id"]): r["f"] for r in f.collect()}
    assert got == {("q", "a"): 1 / 61, ("q", "b"): 1 / 62.5, ("q", "c"): 1 / 62.5, ("r", "a"): 0.0}
    best = [(r["query_id"], r["item_id"], r["rrf_rank"]) for r in top_by(f, "query_id", "f", "item_id", 2).orderBy("query_id", "rrf_rank").collect()]
    assert best == [("q", "a", 1), ("q", "b", 2), ("r", "a", 1)]
    none = f.withColumn("g", fused_score(["x", "y"], [1.0, 0.0]))
    assert {r["g"] for r in none.collect()} == {0.0}
    with pytest.raises(ValueError):
        fused_score([], [])
    with pytest.raises(ValueError):
        GeneratorConfig(signal_weights={"text_coverage": 1.0}).weights()


def test_category_branches(spark):
    q = spark.createDataFrame([("a", 0), ("b", 1), ("c", 9), ("d", None)], "query_id string, search_category long")
    i = spark.createDataFrame([("x", 1), ("y", 2), ("z", None)], "item_id string, item_category_id long")
    got = {(r["query_id"], r["item_id"]) for r in C.category_pairs(q, i).collect()}
    assert got == {("b", "x")} | {(k, x) for k in "acd" for x in "xyz"}


def _catalogue(spark):
    items = [(f"{k:016x}", f"Товар номер{k}", None if k % 3 else "описание", "Тип услуги", 1, k % 2 or None, 5, 50.0 + k / 100, 30.0) for k in range(8)]
    items.append(items[0])
    i = spark.createDataFrame(items, "item_id string, item_title_raw string, item_description_raw string, item_infm_params_text string, item_category_id long, item_microcat_id long, item_location_id long, item_latitude double, item_longitude double")
    q = spark.createDataFrame([("q1", "номер3", 5, False, None, 1), ("q2", None, None, None, "тип", 0)], "query_id string, search_query string, search_location_id long, search_is_delivery_search boolean, search_infm_params_text string, search_category long")
    return q, i


def test_generation_and_packing(spark):
    q, i = _catalogue(spark)
    out = C.generate_with_features(q, i, GeneratorConfig(top_k=3)).collect()
    assert len(out) == 6 and {r["rrf_rank"] for r in out} == {1, 2, 3}
    assert min(out, key=lambda r: (r["query_id"], r["rrf_rank"]))["item_id"] == f"{3:016x}"
    p = {r["query_id"]: r for r in C.packed(C.generate(q, i, GeneratorConfig(top_k=3))).collect()}
    assert p["q1"]["n_candidates"] == 3 and p["q1"]["candidate_item_ids"][0] == f"{3:016x}"
    assert C.generate(q.limit(0), i).count() == 0 and C.generate(q, i.limit(0)).count() == 0


def test_labels_sampling_and_corpus(spark):
    head = "interaction_id long, ingested_at long, search_query string, search_infm_params_text string, search_category long, search_location_id long, search_is_delivery_search boolean, item_id string"
    rest = ["item_title_raw string", "item_description_raw string", "item_infm_params_text string", "item_category_id long", "item_microcat_id long", "item_location_id long", "item_latitude double", "item_longitude double"]
    pad = (None,) * 8
    rows = [(1, 1, "б", None, 1, None, True, "x", *pad), (2, 1, "б", "", 1, 7, False, "y", *pad), (3, 1, None, "p", 2, 8, None, "x", *pad), (4, 1, "а", "p", None, 9, True, None, *pad)]
    train = spark.createDataFrame(rows, ", ".join([head, *rest]))
    got = [(r["query_id"], r["search_query"], r["search_infm_params_text"], r["search_location_id"], r["search_is_delivery_search"], r["n_relevant"], r["n_interactions"]) for r in L.relevance_labels(train).orderBy("query_id").collect()]
    assert got == [("train_000000", "а", "p", 9, True, 0, 0), ("train_000001", "б", "", 7, True, 2, 2), ("train_000002", None, "p", 8, None, 1, 1)]
    labels = L.relevance_labels(train)
    relevance = L.long_relevance(labels, train)
    assert sorted(tuple(r) for r in relevance.collect()) == [("train_000001", "x"), ("train_000001", "y"), ("train_000002", "x")]
    assert L.sample_queries(labels, 10, max_relevant=1).count() == 2
    corpus = L.evaluation_corpus(train.where("item_id = 'y'").select(*T.ITEM_COLUMNS), train, relevance)
    assert sorted((r["item_id"], r["origin"]) for r in corpus.collect()) == [("x", "extra"), ("y", "benchmark")]
    v = labels.where("query_id = 'train_000001'")
    assert [r["query_id"] for r in L.training_queries(labels, v, train, corpus, 5).collect()] == ["train_000002"]


def test_recall(spark):
    rel = spark.createDataFrame([("q", "a"), ("q", "b"), ("r", "c")], "query_id string, item_id string")
    pred = spark.createDataFrame([("q", "a", 1), ("q", "a", 2), ("q", "x", 3), ("q", "b", 4), ("z", "c", 1)], "query_id string, item_id string, rrf_rank long")
    got = {(r["query_id"], r["k"]): r["recall"] for r in V.recall_per_query(pred, rel, [1, 3, 4]).collect()}
    assert got == {("q", 1): 0.5, ("q", 3): 0.5, ("q", 4): 1.0, ("r", 1): 0.0, ("r", 3): 0.0, ("r", 4): 0.0}
    assert V.recall_at_k(pred, rel.limit(0), [1]).count() == 0
    assert V.relevant_item_coverage(rel, spark.createDataFrame([("a",)], "item_id string")).first()[0] == pytest.approx(1 / 3)
    assert V.relevant_item_coverage(rel.limit(0), rel).first()[0] is None


def test_explore(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (1, 2, float("nan")), (None, None, 3.0), (2, 2, None)], "a long, b long, v double")
    assert X.match_rate(df, "a", "b").first()[0] == 0.5
    assert {tuple(r) for r in X.match_rate(df, "a", "b", "a").collect()} == {(1, 0.5, 2), (2, 1.0, 1)}
    assert {r[0]: r[1] for r in X.missing_rates(df).collect()} == {"a": 0.25, "b": 0.25, "v": 0.5}
    d = X.describe(df, ["v"]).first()
    assert (d["n"], d["mean"], d["q50"]) == (2, 2.0, 2.0)
    assert {(r["bin"], r["n"]) for r in X.histogram(df, F.col("v"), 4).collect()} == {(0, 1), (3, 1)}
    p = X.propensity(df, df, numeric=["v"]).first()
    assert (p["chosen"], p["delta"]) == (2.0, 0.0)
    s = spark.createDataFrame([(float(k), float(-k * k)) for k in range(6)], "x double, y double")
    assert X.spearman(s, [("x", "y")]).first()["rho"] == pytest.approx(-1.0)
    assert {r["v"]: r["rank"] for r in X.average_ranks(spark.createDataFrame([(1,), (1,), (5,)], "x long"), "x").collect()} == {1: 1.5, 5: 3.0}


def test_features_and_reranking(spark):
    raw = spark.createDataFrame([("a", 4.0, 3, 100.0, True, False), ("b", float("nan"), None, -1.0, None, True)], "item_id string, item_rating double, item_rating_reviews_count long, item_price double, item_is_phone_hidden boolean, item_is_message_forbidden boolean")
    got = {r["item_id"]: r for r in item_content_features(raw).collect()}
    assert got["a"]["item_price_log1p"] == pytest.approx(math.log(101)) and got["b"]["item_price_log1p"] is None and got["b"]["item_rating"] is None and got["b"]["item_is_phone_hidden"] is None
    first = features_by_priority(raw.where("item_id = 'a'"), raw.withColumn("item_rating", F.lit(1.0)))
    assert {r["item_id"]: r["item_rating"] for r in first.collect()} == {"a": 4.0, "b": 1.0}
    cand = spark.createDataFrame([("q", "a", 1, 1.0), ("q", "b", 2, 1.0), ("q", "c", 3, 2.0)], "query_id string, item_id string, rrf_rank long, s double")
    rel = spark.createDataFrame([("q", "b"), ("q", "b")], "query_id string, item_id string")
    table = feature_table(cand, item_content_features(raw), rel)
    assert {r["item_id"]: r["label"] for r in table.collect()} == {"a": 0, "b": 1, "c": 0}
    again = R.rerank(R.linear_score(table, {"s": 1.0}), "score", 2)
    assert [(r["item_id"], r["rank"]) for r in again.orderBy("rank").collect()] == [("c", 1), ("a", 2)]


def test_pairwise_training_learns_the_signal(spark):
    rows = [(f"q{q}", f"i{q}_{k}", k + 1, float(k == 2) + 0.01 * k, 0.5, int(k == 2)) for q in range(6) for k in range(5)]
    df = spark.createDataFrame(rows, "query_id string, item_id string, rrf_rank long, good double, flat double, label int")
    w = R.train_pairwise(df, ["good", "flat"])
    assert w["good"] > 0 and "flat" not in w
    top = R.rerank(R.apply_pairwise(df, ["good", "flat"], w), "score", 1)
    assert all(r["item_id"].endswith("_2") for r in top.collect())
    assert R.importance(w, df).first()["feature"] == "good"


def test_pairs_are_formed_once_for_fitting(spark, monkeypatch):
    written = []
    monkeypatch.setattr(R, "cut_lineage", lambda df, cut=R.cut_lineage: written.append(df.columns) or cut(df))
    df = spark.createDataFrame([("q", f"i{k}", k % 3 / 2, int(k == 2)) for k in range(6)], "query_id string, item_id string, good double, label int")
    assert R.train_pairwise(df, ["good"])["good"] > 0 and written == [["y", "good"]]


def test_answers(spark):
    pred = spark.createDataFrame([("q", "a" * 16, 1), ("q", "a" * 16, 2), ("q", "b" * 16, 3), ("q", "c" * 16, 4)], "query_id string, item_id string, rank long")
    ids = spark.createDataFrame([("q",), ("r",), ("q",)], "query_id string")
    answer = U.build_answer(pred, ids, 3)
    assert {tuple(r) for r in answer.collect()} == {("q", f"{'a' * 16} {'b' * 16}"), ("r", "")}
    items = spark.createDataFrame([("a" * 16,), ("b" * 16,)], "item_id string")
    assert U.validate_answer(answer, ids, items).count() == 0
    bad = spark.createDataFrame([("q", f"{'a' * 16} {'a' * 16} zz {'d' * 16}"), ("q", ""), ("x", "")], "query_id string, answer string")
    got = {r["code"]: (r["n"], r["examples"]) for r in U.validate_answer(bad, ids, items, 3).collect()}
    assert got == {
        "row_count": (3, []), "duplicate_query": (1, ["q"]), "missing_query": (1, ["r"]), "unexpected_query": (1, ["x"]), "too_long": (1, ["q"]),
        "duplicate_items": (1, ["q"]), "malformed_item": (1, ["q: zz"]), "unknown_item": (1, [f"q: {'d' * 16}"]),
    }
    assert [r["code"] for r in U.validate_answer(bad.select("answer", "query_id"), ids, items).collect()] == ["columns"]


def test_tables(spark, tmp_path):
    with pytest.raises(ValueError):
        T.checked(spark.range(1), ["id", "nothing"])
    df = spark.createDataFrame([("k", 2, "late"), ("k", 1, "early"), (None, 1, "x")], "k string, o long, v string")
    assert {(r["k"], r["v"]) for r in T.first_per_key(df, "k", ["o"]).collect()} == {("k", "early"), (None, "x")}
    texts = spark.createDataFrame([("a b",), ("a b",), (None,)], "t string")
    embed = lambda d, k, t: hash_embedding(d.withColumn("ts", tokens(F.col(t))), k, "ts")
    cache = str(tmp_path / "cache")
    one = T.cached_embeddings(texts, "t", embed, "m", "query", cache)
    assert one.count() == 3 and spark.read.parquet(cache).count() == 2
    two = T.cached_embeddings(spark.createDataFrame([("a b",), ("new text",)], "t string"), "t", embed, "m", "query", cache)
    assert two.count() == 2 and spark.read.parquet(cache).count() == 3
    with pytest.raises(ValueError):
        T.embedding_key("m", "document", "t")
    answer = spark.createDataFrame([("b", ""), ("a", "x y")], "query_id string, answer string")
    T.write_answer(answer, str(tmp_path / "answer"))
    lines = [x for f in sorted((tmp_path / "answer").glob("part-*")) for x in f.read_text().splitlines() if x != "query_id,answer"]
    assert lines == ["a,x y", "b,"]
    asked = spark.createDataFrame([("b", 0), ("a", 1), ("b", 2)], "query_id string, position long")
    ordered = U.build_answer(spark.createDataFrame([("a", "x", 1)], "query_id string, item_id string, rank long"), asked)
    T.write_answer(ordered, str(tmp_path / "ordered"))
    lines = [x for f in sorted((tmp_path / "ordered").glob("part-*")) for x in f.read_text().splitlines() if x != "query_id,answer"]
    assert lines == ["b,", "a,x"]


def _scattered(spark, n=260, seed=3):
    r = random.Random(seed)
    words = [f"слово{k}" for k in range(30)]
    text = lambda k: " ".join(r.sample(words, k))
    items = [
        (f"{k:016x}", text(2), None if k % 5 == 0 else text(r.randint(1, 6)), None if k % 4 == 0 else text(2), r.choice([1, 1, 1, 2, None]), r.choice([7, 8, 9, None]), r.choice([5, 6, None]), r.choice([None, 50.0 + r.random()]), 30.0 + r.random() / 10)
        for k in range(n)
    ]
    queries = [(f"q{k}", None if k == 3 else text(3), r.choice([5, 6, 77, None]), True, None if k == 4 else text(2), r.choice([0, 1, 2, 99, None])) for k in range(12)]
    i = spark.createDataFrame(items + items[:3], "item_id string, item_title_raw string, item_description_raw string, item_infm_params_text string, item_category_id long, item_microcat_id long, item_location_id long, item_latitude double, item_longitude double")
    q = spark.createDataFrame(queries + [("q0", "слово1", 5, True, None, 0)], "query_id string, search_query string, search_location_id long, search_is_delivery_search boolean, search_infm_params_text string, search_category long")
    return q, i


@pytest.mark.parametrize("block", [32_768, 40])
def test_blocks_rank_like_the_pairs(spark, monkeypatch, block):
    """Ranks found block by block are those among all pairs, whatever the blocks and the weights."""
    monkeypatch.setattr(blocks, "ITEM_BLOCK", block)
    monkeypatch.setattr(blocks, "QUERY_BLOCK", 5)
    monkeypatch.setattr(blocks, "LEAST_QUERIES", 3)
    q, i = _scattered(spark)
    q, i = C.cut_lineage(C.prepare_queries(q)), C.cut_lineage(C.prepare_items(i))
    semantic = C.params_matches(q, i)
    weightings = [[1.0] * 5, [2.0, 0.0, 1.0, 0.5, 1.0], [0.0, 1.0, 0.0, 0.0, 0.0]]
    scored = C.score_pairs(q, i, semantic=semantic)
    ranked = C.cut_lineage(with_rank_terms(scored, "uid", "item_id", list(SCORES)))
    got = C.best_items(q, i, GeneratorConfig(top_k=9), weightings).collect()
    shown = lambda r: (r["uid"], r["query_id"], r["item_id"], r["rrf_rank"], round(r["rrf_score"], 12), *(round(r[c], 6) for c in SCORES), None if r["location_distance_km"] is None else round(r["location_distance_km"], 2))
    for n, w in enumerate(weightings):
        want = top_by(ranked.withColumn("rrf_score", fused_score(list(SCORES), w)), "uid", "rrf_score", "item_id", 9)
        assert {shown(r) for r in got if r["variant"] == n} == {shown(r) for r in want.collect()}
    assert len({r["uid"] for r in got}) == 13


def test_hot_queries_rank_like_the_others(spark, monkeypatch):
    r = random.Random(1)
    rows = {(r.choice(["hot", "hot", "a", "b"]), f"i{r.randrange(90)}"): (float(r.randrange(4)), 1.0, r.random()) for _ in range(300)} | {("one", "i"): (1.0, 1.0, 1.0)}
    df = spark.createDataFrame([(*k, *v) for k, v in rows.items()], "query_id string, item_id string, x float, y float, z float")
    plain = {tuple(r) for r in with_rank_terms(df, "query_id", "item_id", ["x", "y", "z"]).collect()}
    monkeypatch.setattr(fusion, "ONE_TASK", 60)
    hot = with_rank_terms(df, "query_id", "item_id", ["x", "y", "z"])
    assert {tuple(r) for r in hot.select(*df.columns, "rank_x", "rank_y", "rank_z").collect()} == plain
    every = top_by(df, "query_id", "z", "item_id", None, "at").collect()
    assert sorted((r["query_id"], r["at"]) for r in every) == sorted((q, k + 1) for q in {q for q, _ in rows} for k in range(sum(p == q for p, _ in rows)))


def test_another_text_signal(spark):
    q, i = _catalogue(spark)
    mine = spark.createDataFrame([("q1", f"{6:016x}", 5.0)], "query_id string, item_id string, score double")
    only = GeneratorConfig(top_k=2, signal_weights=dict.fromkeys(SIGNALS, 0.0) | {"text_coverage": 1.0})
    got = C.generate_with_features(q, i, only, text_score=mine).where("query_id = 'q1' AND rrf_rank = 1").first()
    assert got["item_id"] == f"{6:016x}" and got["text_coverage_score"] == 5.0


def test_block_products(spark, monkeypatch):
    from quern.functions import vectors

    monkeypatch.setattr(vectors, "LEFT_BLOCK", 3)
    monkeypatch.setattr(vectors, "RIGHT_BLOCK", 4)
    r = random.Random(4)
    v = spark.createDataFrame([(k, None if k == 5 else [r.random() for _ in range(4)]) for k in range(20)], "i long, embedding array<float>")
    rows = {x["i"]: x["embedding"] for x in v.collect() if x["embedding"]}
    dots = {(a, b): sum(x * y for x, y in zip(rows[a], rows[b])) for a in rows for b in rows}
    both = vectors.block_products(v.withColumnRenamed("i", "a"), v.withColumnRenamed("i", "b"), "a", "b")
    assert {(x["a"], x["b"]): x["similarity"] for x in both.collect()} == pytest.approx(dots, rel=1e-5)
    some = vectors.block_products(v.withColumnRenamed("i", "a"), v.withColumnRenamed("i", "b"), "a", "b", threshold=1.0)
    assert {(x["a"], x["b"]) for x in some.collect()} == {k for k, d in dots.items() if d >= 1.0}
    top = top_by(vectors.block_products(v.withColumnRenamed("i", "a"), v.withColumnRenamed("i", "b"), "a", "b", k=2), "a", "similarity", "b", 2)
    assert {(x["a"], x["b"]) for x in top.collect()} == {(a, b) for a in rows for b in sorted(rows, key=lambda b: -dots[a, b])[:2]}
    assert vectors.block_products(v.withColumnRenamed("i", "a").limit(0), v.withColumnRenamed("i", "b"), "a", "b").count() == 0


def test_listwise_boosting_learns_and_stops(spark):
    r = random.Random(7)
    rows = []
    for q in range(40):
        good = r.randrange(12)
        for k in range(12):
            x = 1.0 if k == good else r.random() * 0.9
            rows.append((f"q{q}", f"i{q}_{k}", k + 1, x, r.random(), None if r.random() < 0.1 else r.random(), int(k == good)))
    df = spark.createDataFrame(rows, "query_id string, item_id string, rrf_rank long, good double, noise double, holes double, label int")
    train, held = df.where("query_id < 'q3'"), df.where("query_id >= 'q3'")
    model = R.train_listwise(train, ["good", "noise", "holes"], held, iterations=6, patience=2, k=1)
    assert 1 <= len(model.trees) <= len(model.history) <= 6 and max(model.history) == model.history[len(model.trees) - 1] > 0.9
    top = R.rerank(model.score(held), "score", 1)
    wanted = {x["item_id"] for x in held.where("label = 1").collect()}
    got = {x["item_id"] for x in top.collect()}
    assert len(got & wanted) / len(wanted) == max(model.history)
    assert model.importance(spark).first()["feature"] == "good"


def test_boosting_shuffles_rows_once_a_round(spark, monkeypatch):
    """Scores and targets are written together, and neither they nor the scored rows are joined."""
    plans = []

    def noted(df, cut=R.cut_lineage):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(R, "cut_lineage", noted)
    df = spark.createDataFrame([(f"q{q}", f"i{k}", k + 1, k / 5, int(k == q % 3)) for q in range(6) for k in range(5)], "query_id string, item_id string, rrf_rank long, good double, label int")
    model = R.train_listwise(df, ["good"], iterations=2)
    assert len(plans) == 2 and all("Join" not in p and p.count("Exchange ") <= 1 for p in plans)
    scored = model.score(df)
    assert scored.columns == [*df.columns, "score"] and "Join" not in scored._jdf.queryExecution().executedPlan().toString()
    assert max(abs(r["s"]) for r in model.trees[0].transform(R.assembled(df, ["good"])[0]).selectExpr("_t AS s").collect()) * model.scales[0] == pytest.approx(1)


def test_a_model_is_loaded_once(spark):
    def load():
        return lambda texts: [[len(t), t.count("a"), 1.0] for t in texts]

    embed = model_encoder("counts", load, batch=2, length=4)
    df = spark.createDataFrame([("x", "aaaaaa"), ("y", None), ("z", "b"), ("w", "")], "id string, text string")
    got = {r["id"]: list(r["embedding"]) for r in embed(df, "id", "text").collect()}
    assert got["x"] == pytest.approx([4 / math.sqrt(33), 4 / math.sqrt(33), 1 / math.sqrt(33)]) and got["y"] == got["w"] == [0.0, 0.0, 1.0]
