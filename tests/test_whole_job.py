"""The registered queries do the whole job: no sample or cut where the reference has none."""

import pytest
from pyspark.sql import functions as F

from quern import ranking_queries as Q
from quern.config import SCORES
from quern.functions.vectors import hash_embedding, with_hash_vectors
from quern.operators import blocks
from quern.operators import candidates as C
from quern.operators import labels as L
from quern.operators.features import feature_table

N_QUERIES = 900
_ITEM = "item_id string, item_title_raw string, item_description_raw string, item_infm_params_text string, item_category_id long, item_microcat_id long, item_location_id long, item_latitude double, item_longitude double"
_QUERY = "search_query string, search_location_id long, search_is_delivery_search boolean, search_infm_params_text string, search_category long"


def _item(k):
    return (f"{k:016x}", f"товар номер{k}", None, None, 1, k % 2, 5, 50.0, 30.0)


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    """More labelled queries than any sample takes, each with one item; every ninth item isn't in the corpus."""
    d = str(tmp_path_factory.mktemp("data"))
    train = [(k, 1, f"номер{k}", 5, False, None, 1, *_item(k)) for k in range(N_QUERIES)]
    spark.createDataFrame(train, f"interaction_id long, ingested_at long, {_QUERY}, {_ITEM}").write.parquet(f"{d}/train.parquet")
    spark.createDataFrame([_item(k) for k in range(N_QUERIES) if k % 9], _ITEM).write.parquet(f"{d}/benchmark_items.parquet")
    queries = [(f"q{k}", f"номер{k}", 5, False, None, 1) for k in range(2)]
    spark.createDataFrame(queries, f"query_id string, {_QUERY}").write.parquet(f"{d}/benchmark_queries.parquet")
    # The last of 300 by fusion is the 50th by the linear score: (id, text coverage, the other four scores).
    logged = [(f"b{k}", 1.0, 1.0) for k in range(49)] + [("x", 0.9, 0.0)] + [(f"a{k}", 0.0, 1.0) for k in range(250)]
    candidates = [("q0", i, other, text, other, other, other) for i, text, other in logged]
    spark.createDataFrame(candidates, "query_id string, item_id string, " + ", ".join(f"{c} float" for c in SCORES)).write.parquet(f"{d}/candidates.parquet")
    return d


def test_training_split_takes_all_reachable_queries(spark, data):
    labels = {r["query_id"]: r["item_id"] for r in Q.relevance_long(spark, data).collect()}
    validation = {r["query_id"] for r in Q.sample_queries(spark, data).collect()}
    want = {q for q, item in labels.items() if q not in validation and int(item, 16) % 9}
    assert len(want) > 60
    assert {r["query_id"] for r in Q.train_split_reachable(spark, data).collect()} == want
    assert Q.split_overlap(spark, data).first()["n_shared"] == 0


def test_params_are_also_matched_by_meaning(spark):
    """The hash embedder gives вид3 and вид28 the same vector."""
    items = spark.createDataFrame([(f"{k:016x}", "товар", None, p, 1, 1, 5, 50.0, 30.0) for k, p in enumerate(["вид3", "вид4", "вид28"])], _ITEM)
    queries = spark.createDataFrame([("q", "товар", 5, False, "вид28", 1)], f"query_id string, {_QUERY}")
    got = {int(r["item_id"], 16): r["params_coverage_score"] for r in C.generate_with_features(queries, items).collect()}
    assert got == {0: 1.0, 1: 0.0, 2: 1.0}
    none = spark.createDataFrame([], "token string, item_id string")
    got = {int(r["item_id"], 16): r["params_coverage_score"] for r in C.generate_with_features(queries, items, semantic=none).collect()}
    assert got == {0: 0.0, 1: 0.0, 2: 1.0}


def test_all_logged_candidates_are_reranked(spark, data):
    got = {r["item_id"]: r["rank"] for r in Q.rerank_topk(spark, data).collect()}
    assert len(got) == 50 and got["x"] == 50


def test_evaluation_takes_800_queries(spark, data):
    got = {r["query_id"] for r in Q.sample_queries(spark, data).collect()}
    assert len(got) == 800
    wanted = {int(r["item_id"], 16) for r in Q.relevance_long(spark, data).collect() if r["query_id"] in got}
    extra = {k for k in wanted if k % 9 == 0}
    assert extra and {int(r["item_id"], 16) for r in Q.eval_corpus(spark, data).collect()} == extra | {k for k in range(N_QUERIES) if k % 9}


def test_first_stage_keeps_500_candidates(spark, data):
    assert {r["query_id"]: r["n_candidates"] for r in Q.candidates_packed(spark, data).collect()} == {"q0": 500, "q1": 500}
    assert Q.candidates_topk(spark, data).where("rrf_rank = 500").count() == 2
    assert Q.candidates_with_features(spark, data).count() == 1000


@pytest.mark.parametrize("query", [Q.candidates_topk, Q.candidates_with_features, Q.candidates_packed])
def test_candidates_are_not_shuffled(spark, data, query):
    """They leave the task that ranks them for the result: its queries are exchanged, and nothing after it."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = query(spark, data)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "CoGroup" not in plan and "Join" not in plan and plan.count("Exchange ") == 1
    assert plan.index("MapInArrow") < plan.index("Exchange ")


def test_items_are_written_once_besides_their_blocks(spark, data, monkeypatch):
    """Of the items' tokens and vectors there is one table and the packed blocks: further copies fill the disk."""
    written = []

    def noted(df, cut=C.cut_lineage):
        written.append(set(df.columns))
        return cut(df)

    monkeypatch.setattr(C, "cut_lineage", noted)
    monkeypatch.setattr(blocks, "cut_lineage", noted)
    Q.candidates_with_features(spark, data)
    assert sum("item_id" in c for c in written) == 1 and sum("block" in c for c in written) == 1


def test_vectors_made_in_place_are_those_of_the_embedder(spark):
    rows = [(1, ["слово", "b", "b", "c"]), (2, []), (3, None), (4, [None, "x1", "x2", "x3"])]
    df = spark.createDataFrame(rows, "i long, ts array<string>")
    want = {r["i"]: r["embedding"] for r in hash_embedding(df, "i", "ts").collect()}
    assert {r["i"]: r["embedding"] for r in with_hash_vectors(df, "ts").collect()} == want


def test_features_and_labels_come_along_with_the_candidates(spark, data):
    """The reranker's table is the joined one, but no candidate is shuffled or joined for it."""
    q, i = (spark.read.parquet(f"{data}/benchmark_{x}.parquet") for x in ("queries", "items"))
    content = spark.createDataFrame([(f"{k:016x}", k / 2, None if k % 3 else k) for k in range(0, N_QUERIES, 2)], "item_id string, item_rating double, item_is_phone_hidden int")
    relevance = spark.createDataFrame([("q0", f"{k:016x}") for k in (1, 1, 2, 9, 400)] + [("q7", f"{3:016x}")], "query_id string, item_id string")
    flags = q.selectExpr("query_id", "int(query_id = 'q1') AS search_is_delivery_search")
    asked = q.drop("search_is_delivery_search").withColumn("search_is_delivery_search", F.lit(None).cast("boolean"))
    got = C.generate_labelled(asked, i, content, relevance, flags)
    want = feature_table(C.generate_with_features(asked, i), content, relevance, flags)
    assert got.columns == want.columns and got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    assert got.where("label = 1").count() >= 2
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = C.generate_labelled(asked, i, content, relevance, flags)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Join" not in plan and plan.count("Exchange ") == 1 and plan.index("MapInArrow") < plan.index("Exchange ")


def test_queries_pass_over_blocks_of_other_categories(spark, monkeypatch):
    """And the next task of a worker finds its blocks unpacked."""
    rows = [(*_item(k)[:4], k % 3 or None, *_item(k)[5:]) for k in range(300)]
    items = spark.createDataFrame(rows, _ITEM)
    queries = spark.createDataFrame([("q", "номер7", 5, False, None, 1), ("r", "номер8", 5, False, None, 0)], f"query_id string, {_QUERY}")
    made = []
    run = blocks.BlockRanker.run
    monkeypatch.setattr(blocks, "ITEM_BLOCK", 30)
    monkeypatch.setattr(blocks.BlockRanker, "run", lambda ranker, lists: made.append(ranker) or run(ranker, lists))
    got = C.generate_with_features(queries, items)
    assert {(r["query_id"], r["n"]) for r in got.groupBy("query_id").agg(F.count("*").alias("n")).collect()} == {("q", 100), ("r", 300)}
    corpus = blocks._corpus(made[0].items._cut_at, 5.0)
    every, some = list(corpus({None})), list(corpus({1}))
    of_one = lambda found: sum(b - a for a, b in (x.span(1) for _, x in found))
    assert len(some) < len(every) and sum(x.n for _, x in every) == 300 and of_one(some) == of_one(every) == 100
    again = list(blocks._corpus(made[0].items._cut_at, 5.0)({1}))
    assert [n for n, _ in again] == [n for n, _ in some] and again[0][1] is some[0][1]


def test_queries_of_many_relevant_items_are_trained_on_too(spark, data, monkeypatch):
    """However many: their labels come from a table that workers read, not from a list."""
    labels = spark.createDataFrame([("a", "few", 1), ("b", "many", 201)], "query_id string, search_query string, n_relevant long").withColumn("search_infm_params_text", F.lit("")).withColumn("search_category", F.lit(1).cast("long")).withColumn("group_key", L._group_key())
    train = labels.withColumn("item_id", F.lit("x"))
    assert {r["query_id"] for r in L.training_queries(labels, labels.limit(0), train, train, None).collect()} == {"a", "b"}
    monkeypatch.setattr(C, "LISTED", 3)
    q, i = (spark.read.parquet(f"{data}/benchmark_{x}.parquet") for x in ("queries", "items"))
    pairs = [("q0", f"{k:016x}") for k in range(1, 800)] + [("q1", f"{k:016x}") for k in (1, 2, 3)] + [("q7", f"{k:016x}") for k in range(9)]
    relevance = spark.createDataFrame(pairs, "query_id string, item_id string")
    content, flags = i.select("item_id", F.lit(1.0).alias("item_rating")), q.select("query_id", F.lit(1).alias("flag"))
    got = C.generate_labelled(q, i, content, relevance, flags)
    want = feature_table(C.generate_with_features(q, i), content, relevance, flags)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    assert got.where("label = 1").groupBy("query_id").count().where("count > 3").count() == 1


def test_importance_ranks_the_training_queries_only(spark, monkeypatch):
    """And the rerankers each table once."""
    made = []
    table = spark.createDataFrame([], "query_id string, item_id string, label int, rrf_rank long")
    monkeypatch.setattr(Q, "_features", lambda spark, d, queries, corpus, relevance: made.append(queries) or table)
    for name in ("_labels", "_train", "_items"):
        monkeypatch.setattr(Q, name, lambda spark, d: table)
    monkeypatch.setattr(Q, "_validation", lambda labels: table)
    for name in ("training_queries", "long_relevance", "evaluation_corpus"):
        monkeypatch.setattr(Q.L, name, lambda *_: table)
    fitted = []
    monkeypatch.setattr(Q.R, "train_pairwise", lambda *_: fitted.append(1) or {})
    monkeypatch.setattr(Q.R, "importance", lambda *_: table)
    Q.ltr_importance(spark, "")
    assert len(made) == len(fitted) == 1


def test_all_encoded_columns_are_explored(spark, tmp_path):
    d = str(tmp_path)
    features = "item_price double, item_rating double, item_rating_reviews_count long, item_is_phone_hidden boolean, item_is_message_forbidden boolean"
    rows = [(5, k % 2 == 0, 1, *_item(k), 100.0 * k, 1.0 + k % 5, k, k % 3 == 0, k % 4 == 0) for k in range(40)]
    df = spark.createDataFrame(rows, f"search_location_id long, search_is_delivery_search boolean, search_category long, {_ITEM}, {features}")
    df.write.parquet(f"{d}/train.parquet")
    df.write.parquet(f"{d}/benchmark_items.parquet")
    pairs = {(r["a"], r["b"]) for r in Q.spearman_matrix(spark, d).collect()}
    assert len(pairs) == 28 and len({x for p in pairs for x in p}) == 8
    n = {}
    for r in Q.hist_density(spark, d).collect():
        n[r["feature"], r["population"]] = n.get((r["feature"], r["population"]), 0) + r["n"]
    known = {"item_rating": 40, "item_rating_reviews_count_log1p": 40, "item_price_log1p": 39}
    assert n == {(f, p): k for f, k in known.items() for p in ("chosen", "corpus")}


def test_every_vector_is_scored(spark, tmp_path):
    rows = [(k, k % 2, [1.0, float(k)]) for k in range(30)]
    spark.createDataFrame(rows, "vec_id long, label long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert {(r["vec_id"], r["label"]) for r in Q.microcat_score(spark, str(tmp_path)).collect()} == {(k, x) for k in range(30) for x in range(2)}
