"""Registered queries of the search operators: signals, fusion, candidates, evaluation, exploration, answers."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.config import SCORES, GeneratorConfig
from quern.functions.text import lemmatize, prefix, tokens
from quern.functions.vectors import block_products, hash_embedding, mean_vectors
from quern.operators import candidates as C
from quern.operators import evaluate as V
from quern.operators import explore as X
from quern.operators import labels as L
from quern.operators import rerank as R
from quern.operators import signals as S
from quern.operators import submission as U
from quern.operators.features import FEATURE_COLUMNS, features_by_priority, item_content_features
from quern.operators.fusion import fused_score, top_by, with_rank_terms
from quern.plans.lineage import cut_lineage, shared_dir
from quern.plans.ranks import average_ranks
from quern.plans.skew import join_weighted, spread
from quern.sources import tables as T

Query = Callable[[SparkSession, str], DataFrame]

#: Settings of the registered queries: evaluated queries, the second stage's length, and the threshold of the semantic
#: queries. The first stage keeps ``CONFIG.top_k`` = 500; training takes all reachable labels.
N_VALIDATION, TOP_K, SEMANTIC = 800, 50, 0.35
#: Relevant items of a query of the reported split at most, as its SQL has it; the rankers train on all.
MOST_SPLIT = 200
CONFIG = GeneratorConfig()


def _items(spark: SparkSession, d: str) -> DataFrame:
    return T.load_dataset(spark, d)["benchmark_items"]


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return T.load_dataset(spark, d)["benchmark_queries"]


def _train(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "train")


def tokenize_docs(spark: SparkSession, d: str) -> DataFrame:
    t = tokens(F.col("text"))
    return T.table(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"), F.md5(F.array_join(t, " ")).alias("digest"))


def tokenize_lemmas(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of the searches by a lemma dictionary. There is no dictionary here, so one is made by rule: endings are cut."""
    searches = cut_lineage(_queries(spark, d).select("query_id", "search_query").where("query_id IS NOT NULL").distinct().withColumn("ts", tokens(F.col("search_query"), drop_stopwords=False)))
    known = searches.select(F.explode("ts").alias("token")).distinct()
    lemmas = known.where(F.length("token") >= 5).withColumn("lemma", F.regexp_replace("token", "(ами|ями|ов|ев|ах|ях|ой|ый|ий|[аяоеуюыи])$", ""))
    return lemmatize(searches, "ts", lemmas).select("query_id", F.size("ts").cast("long").alias("n_tokens"), F.md5(F.array_join("ts", " ")).alias("digest"))


def embedding_cache(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings of the searches' first 200 characters with their prompt, from a cache that a first run fills in part and a
    second completes: the places and values that aren't zero."""
    texts = _queries(spark, d).where("query_id IS NOT NULL").select("query_id", prefix(F.col("search_query")).alias("t")).distinct()
    embed = lambda df, key, text: hash_embedding(df.withColumn("ts", tokens(F.col(text))), key, "ts")
    path = f"{shared_dir(spark)}/embeddings-{uuid.uuid4().hex}"
    T.cached_embeddings(texts.where("query_id < 'q8'"), "t", embed, "hash", "query", path)
    both = T.cached_embeddings(texts, "t", embed, "hash", "query", path)
    return both.select("query_id", F.posexplode("embedding").alias("pos", "v")).where("v <> 0").select("query_id", "pos", F.round(F.col("v").cast("double"), 6).alias("v"))


def vocab_distinct(spark: SparkSession, d: str) -> DataFrame:
    texts = _train(spark, d).select(F.col("search_infm_params_text").alias("t")).unionByName(_queries(spark, d).select(F.col("search_infm_params_text").alias("t"))).distinct()
    return texts.select(F.explode(tokens(F.col("t"))).alias("token")).distinct()


def _sparse(spark: SparkSession, d: str, query_text: str, item_tokens) -> DataFrame:
    q = _queries(spark, d).where("query_id IS NOT NULL").select("query_id", S.distinct_tokens(F.col(query_text)).alias("qt"))
    # An item's rows are united, so repeated ones don't matter, and only the texts move.
    i = spread(_items(spark, d).where("item_id IS NOT NULL"), "item_id").select("item_id", item_tokens.alias("it"))
    return S.coverage_summary(q, i, "query_id", "item_id", "qt", "it").withColumn("total", F.round("total", 4))


def text_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per query: items with a common token, best and total coverage of title and description."""
    return _sparse(spark, d, "search_query", S.item_text_tokens())


def params_coverage_exact(spark: SparkSession, d: str) -> DataFrame:
    return _sparse(spark, d, "search_infm_params_text", S.distinct_tokens(F.col("item_infm_params_text")))


def _meanings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Vectors of the closed query vocabulary's tokens and of the items' params."""
    v = hash_embedding(vocab_distinct(spark, d).withColumn("ts", F.array("token")), "token", "ts")
    items = _items(spark, d).where("item_id IS NOT NULL").groupBy("item_id").agg(F.min(S.distinct_tokens(F.col("item_infm_params_text"))).alias("ts"))
    return v, hash_embedding(items, "item_id", "ts")


def _semantic(spark: SparkSession, d: str) -> DataFrame:
    return S.semantic_matches(*_meanings(spark, d), "item_id", SEMANTIC)


def semantic_match_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Per token of the closed query vocabulary: items whose params are near in meaning."""
    return _semantic(spark, d).groupBy("token").agg(F.count(F.lit(1)).alias("n_items"))


def params_coverage_semantic(spark: SparkSession, d: str) -> DataFrame:
    q = _queries(spark, d).where("query_id IS NOT NULL").select("query_id", S.distinct_tokens(F.col("search_infm_params_text")).alias("qt"))
    i = spread(_items(spark, d).where("item_id IS NOT NULL"), "item_id").select("item_id", S.distinct_tokens(F.col("item_infm_params_text")).alias("it"))
    vocabulary, vectors = _meanings(spark, d)
    return S.coverage_summary(q, i, "query_id", "item_id", "qt", "it", near=(cut_lineage(vocabulary), vectors, SEMANTIC)).withColumn("total", F.round("total", 4))


def dense_similarity_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest other vectors of every vector whose id is divisible by 20."""
    e = T.table(spark, d, "embeddings")
    near = block_products(e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_vec"), e, "query_vec", "vec_id", k=11)
    return top_by(near.where("query_vec <> vec_id"), "query_vec", "similarity", "vec_id", 10, "position")


def location_centroids(spark: SparkSession, d: str) -> DataFrame:
    return S.location_centroids(_items(spark, d).where("item_id IS NOT NULL").distinct())


def location_signal(spark: SparkSession, d: str) -> DataFrame:
    """Score and distance of every logged pair's search location and item."""
    c = S.location_centroids(_items(spark, d).where("item_id IS NOT NULL").distinct())
    rows = _train(spark, d).select("interaction_id", "search_location_id", "item_location_id", F.col("item_latitude").cast("double").alias("la"), F.col("item_longitude").cast("double").alias("lo")).distinct()
    j = rows.join(c, rows["search_location_id"] == c["location_id"], "left")
    place = [F.col(x) for x in ("search_location_id", "centroid_lat", "centroid_lon", "item_location_id", "la", "lo")]
    return j.select("interaction_id", F.round(S.location_match(*place).cast("double"), 5).alias("score"), F.round(S.location_distance_km(*place), 4).alias("distance_km"))


def microcat_centroids(spark: SparkSession, d: str) -> DataFrame:
    c = mean_vectors(T.table(spark, d, "embeddings"), "label", "embedding")
    return c.select("label", "n", F.posexplode("centroid").alias("pos", "v")).select("label", "n", "pos", F.round(F.col("v").cast("double"), 6).alias("v"))


def microcat_score(spark: SparkSession, d: str) -> DataFrame:
    e = T.table(spark, d, "embeddings")
    c = mean_vectors(e, "label", "embedding")
    s = S.microcat_scores(e, c, "vec_id", "label")
    return s.select("vec_id", "label", F.round(F.col("score").cast("double"), 5).alias("score"))


def _logged_scores(spark: SparkSession, d: str) -> DataFrame:
    """The logged candidates, one row a pair with its best scores; unknown scores are 0."""
    rows = T.table(spark, d, "candidates").where("query_id IS NOT NULL AND item_id IS NOT NULL")
    best = lambda c: F.coalesce(F.max(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))), F.lit(0.0)).cast("float").alias(c)
    return rows.groupBy("query_id", "item_id").agg(*(best(c) for c in SCORES))


def avg_rank_ties(spark: SparkSession, d: str) -> DataFrame:
    """Ranks of text coverage, from counts by value."""
    rows = _logged_scores(spark, d).select("query_id", "item_id", "text_coverage_score")
    ranks = average_ranks(rows, ["query_id"], "text_coverage_score").select("query_id", "text_coverage_score", "n", "rank")
    return join_weighted(rows, ranks, ["query_id", "text_coverage_score"], "n", rows.count()).select("query_id", "item_id", F.col("rank").alias("avg_rank"))


def _fused(df: DataFrame, scores: list[str], weights: list[float]) -> DataFrame:
    ranked = with_rank_terms(df, "query_id", "item_id", scores).withColumn("fused", fused_score(scores, weights))
    return top_by(ranked, "query_id", "fused", "item_id", 20, "position").select("query_id", "item_id", F.round("fused", 9).alias("fused"), "position")


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return _fused(_logged_scores(spark, d), list(SCORES), [1.0] * 5)


def rrf_weighted(spark: SparkSession, d: str) -> DataFrame:
    return _fused(_logged_scores(spark, d), list(SCORES), [2.0, 1.0, 0.5, 0.0, 1.5])


def rrf_constant_skip(spark: SparkSession, d: str) -> DataFrame:
    df = _logged_scores(spark, d).withColumn("constant", F.lit(1.0).cast("float"))
    return _fused(df, ["constant", "text_similarity_score"], [1.0, 1.0])


def category_filter_branches(spark: SparkSession, d: str) -> DataFrame:
    q = _queries(spark, d).where("query_id IS NOT NULL").select("query_id", "search_category").distinct()
    i = _items(spark, d).where("item_id IS NOT NULL").select("item_id", "item_category_id").distinct()
    branch = F.when(F.col("filter_category").isNotNull(), "confined").when(F.coalesce(F.col("search_category") == 0, F.lit(True)), "unspecified").otherwise("absent")
    return C.category_sizes(q, i).select("query_id", branch.alias("branch"), "n_items")


def candidates_with_features(spark: SparkSession, d: str) -> DataFrame:
    out = C.generate_with_features(_queries(spark, d), _items(spark, d), CONFIG)
    return out.withColumns({"rrf_score": F.round("rrf_score", 9), "location_match_score": F.round(F.col("location_match_score").cast("double"), 5), "location_distance_km": F.round(F.col("location_distance_km").cast("double"), 2), "text_similarity_score": F.round(F.col("text_similarity_score").cast("double"), 5), "microcat_match_score": F.round(F.col("microcat_match_score").cast("double"), 5)})


def candidates_topk(spark: SparkSession, d: str) -> DataFrame:
    return C.generate(_queries(spark, d), _items(spark, d), CONFIG)


def candidates_packed(spark: SparkSession, d: str) -> DataFrame:
    p = C.generate_packed(_queries(spark, d), _items(spark, d), CONFIG)
    return p.select("query_id", F.array_join("candidate_item_ids", " ").alias("candidate_item_ids"), "n_candidates")


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return cut_lineage(L.relevance_labels(_train(spark, d)))


def relevance_labels(spark: SparkSession, d: str) -> DataFrame:
    return L.relevance_labels(_train(spark, d)).drop("group_key")


def relevance_long(spark: SparkSession, d: str) -> DataFrame:
    """All relevant (query, item) pairs, one row each."""
    return L.long_relevance(_labels(spark, d), _train(spark, d))


def _validation(labels: DataFrame) -> DataFrame:
    return cut_lineage(L.sample_queries(labels, N_VALIDATION, CONFIG.random_seed))


def sample_queries(spark: SparkSession, d: str) -> DataFrame:
    return _validation(_labels(spark, d)).select("query_id", *T.QUERY_COLUMNS, "n_interactions")


def _evaluation(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Validation queries, evaluation corpus and relevance."""
    v = _validation(_labels(spark, d))
    relevance = cut_lineage(L.long_relevance(v, _train(spark, d)))
    return v, L.evaluation_corpus(_items(spark, d), _train(spark, d), relevance), relevance


def eval_corpus(spark: SparkSession, d: str) -> DataFrame:
    return _evaluation(spark, d)[1]


def train_split_reachable(spark: SparkSession, d: str) -> DataFrame:
    labels = _labels(spark, d)
    return L.training_queries(labels, _validation(labels), _train(spark, d), _items(spark, d), None, max_relevant=MOST_SPLIT).select("query_id", "n_interactions")


def recall_per_query(spark: SparkSession, d: str) -> DataFrame:
    v, corpus, relevance = _evaluation(spark, d)
    found = C.generate(v.select("query_id", *T.QUERY_COLUMNS), corpus.drop("origin"), CONFIG)
    return V.recall_per_query(found, relevance, [50, 100, 200, 250, 500]).withColumn("recall", F.round("recall", 9))


def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    v, corpus, relevance = _evaluation(spark, d)
    found = C.generate(v.select("query_id", *T.QUERY_COLUMNS), corpus.drop("origin"), CONFIG)
    return V.recall_at_k(found, relevance, [50, 100, 200, 250, 500]).withColumn("recall_at_k", F.round("recall_at_k", 9))


def relevant_item_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Before and after the corpus is completed."""
    v, corpus, relevance = _evaluation(spark, d)
    one = V.relevant_item_coverage(relevance, _items(spark, d)).withColumn("corpus", F.lit("benchmark"))
    return one.unionByName(V.relevant_item_coverage(relevance, corpus).withColumn("corpus", F.lit("evaluation"))).select("corpus", F.round("coverage", 9).alias("coverage"))


def ablation(spark: SparkSession, d: str) -> DataFrame:
    v, corpus, relevance = _evaluation(spark, d)
    q, i = cut_lineage(C.prepare_queries(v.select("query_id", *T.QUERY_COLUMNS))), cut_lineage(C.prepare_items(corpus.drop("origin")))
    return V.ablation(q, i, relevance).withColumns({c: F.round(c, 9) for c in ("recall_50", "recall_500")})


def threshold_calibration(spark: SparkSession, d: str) -> DataFrame:
    """Vectors with their own label's centroid against those with the centroid of a vector drawn by permutation."""
    e = T.table(spark, d, "embeddings")
    c = mean_vectors(e, "label", "embedding").select(F.col("label").alias("l"), F.col("centroid").alias("b"))
    own = e.join(c, e["label"] == c["l"]).select("vec_id", F.col("embedding").alias("a"), "b")
    drawn = L.permuted_pairs(e, "vec_id", 0).join(own.select(F.col("vec_id").alias("other_id"), "b"), "other_id").join(e.select("vec_id", F.col("embedding").alias("a")), "vec_id")
    out = V.threshold_calibration(own, drawn, thresholds=(*V.THRESHOLDS, 0.1, 0.2, 0.3, 0.4))
    return out.select("threshold", *(F.round(x, 6).alias(x) for x in ("true_positive_rate", "false_positive_rate", "separation")))


def params_calibration(spark: SparkSession, d: str) -> DataFrame:
    """Params tokens of searches against the params of the chosen item, and against those of an item drawn by permutation,
    for all interactions whose search has params; of the item's params the first 200 characters count."""
    both = _train(spark, d).select("interaction_id", "search_infm_params_text", prefix(F.col("item_infm_params_text")).alias("p")).where("coalesce(search_infm_params_text, '') <> '' AND interaction_id IS NOT NULL")
    rows = cut_lineage(both.groupBy("interaction_id").agg(F.min(F.struct("search_infm_params_text", "p")).alias("x")).select("interaction_id", tokens(F.col("x.search_infm_params_text")).alias("ts"), tokens(F.col("x.p")).alias("it")))
    docs = cut_lineage(hash_embedding(rows, "interaction_id", "it", name="b"))
    vocabulary = rows.select(F.explode("ts").alias("token")).distinct()
    known = cut_lineage(hash_embedding(vocabulary.withColumn("one", F.array("token")), "token", "one", name="a"))
    asked = rows.select("interaction_id", F.explode("ts").alias("token"))
    drawn = L.permuted_pairs(rows, "interaction_id", 0)
    own = asked.join(docs, "interaction_id").join(known, "token")
    other = asked.join(drawn, "interaction_id").drop("interaction_id").join(docs.withColumnRenamed("interaction_id", "other_id"), "other_id").join(known, "token")
    out = V.threshold_calibration(own, other, thresholds=(*V.THRESHOLDS, 0.1, 0.2, 0.3, 0.4))
    return out.select("threshold", *(F.round(x, 6).alias(x) for x in ("true_positive_rate", "false_positive_rate", "separation")))


def split_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Keys shared by the validation and the training queries: none."""
    labels = _labels(spark, d)
    v = _validation(labels)
    return V.shared_keys(v, L.training_queries(labels, v, _train(spark, d), _items(spark, d), None, max_relevant=MOST_SPLIT), "query_id").agg(F.count(F.lit(1)).alias("n_shared"))


def location_match_rate(spark: SparkSession, d: str) -> DataFrame:
    return X.match_rate(T.load_train_features(spark, d), "search_location_id", "item_location_id").withColumn("match_rate", F.round("match_rate", 9))


def location_match_by_group(spark: SparkSession, d: str) -> DataFrame:
    return X.match_rate(T.load_train_features(spark, d), "search_location_id", "item_location_id", "item_category_id").withColumn("match_rate", F.round("match_rate", 9))


def category_agreement(spark: SparkSession, d: str) -> DataFrame:
    return X.match_rate(T.load_train_features(spark, d), "search_category", "item_category_id").withColumn("match_rate", F.round("match_rate", 9))


def location_dispersion(spark: SparkSession, d: str) -> DataFrame:
    out = X.location_dispersion(T.load_item_features(spark, d))
    return out.withColumns({c: F.round(c, 6) for c in ("lat_std", "lon_std")})


def propensity_binary(spark: SparkSession, d: str) -> DataFrame:
    out = X.propensity(T.load_train_features(spark, d), T.load_item_features(spark, d), binary=["item_is_phone_hidden", "item_is_message_forbidden"])
    return out.withColumns({c: F.round(c, 9) for c in ("chosen", "population", "delta")})


def propensity_numeric(spark: SparkSession, d: str) -> DataFrame:
    out = X.propensity(T.load_train_features(spark, d), T.load_item_features(spark, d), numeric=["item_rating", "item_rating_reviews_count"])
    return out.withColumns({c: F.round(c, 6) for c in ("chosen", "population", "delta")})


def missing_rates(spark: SparkSession, d: str) -> DataFrame:
    return X.missing_rates(T.load_item_features(spark, d)).withColumn("missing_rate", F.round("missing_rate", 9))


def value_counts(spark: SparkSession, d: str) -> DataFrame:
    return X.value_counts(_train(spark, d), "search_category")


def nunique_grouped(spark: SparkSession, d: str) -> DataFrame:
    return X.nunique_by(T.load_item_features(spark, d), "item_category_id", "item_microcat_id")


def nunique_global(spark: SparkSession, d: str) -> DataFrame:
    return X.nunique(T.load_item_features(spark, d), ["item_id", "item_category_id", "item_microcat_id", "item_location_id"])


def describe_stats(spark: SparkSession, d: str) -> DataFrame:
    out = X.describe(T.load_item_features(spark, d), ["item_rating", "item_rating_reviews_count", "item_latitude"])
    return out.withColumns({c: F.round(c, 5) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")})


def hist_density(spark: SparkSession, d: str) -> DataFrame:
    """Rating in 30 bins, log1p of reviews and of a positive price in 50, of chosen items and of the corpus."""
    price = F.when(F.col("item_price") > 0, F.col("item_price"))
    values = {"item_rating": (F.col("item_rating"), 30), "item_rating_reviews_count_log1p": (F.log1p(F.col("item_rating_reviews_count").cast("double")), 50), "item_price_log1p": (F.log1p(price), 50)}
    out = None
    for name, df in (("chosen", T.load_train_features(spark, d)), ("corpus", T.load_item_features(spark, d))):
        for feature, (value, bins) in values.items():
            part = X.histogram(df, value, bins).select(F.lit(feature).alias("feature"), F.lit(name).alias("population"), "bin", "n", F.round("density", 6).alias("density"))
            out = part if out is None else out.unionByName(part)
    return out


def encode_correlation(spark: SparkSession, d: str) -> DataFrame:
    """Sums of the encoded columns, and how many rows know them."""
    e = X.encode_for_correlation(T.load_train_features(spark, d))
    row = e.agg(*(F.struct(F.count(c).alias("n"), F.round(F.sum(c), 3).alias("total")).alias(c) for c in e.columns))
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"{c}.n").alias("n"), F.col(f"{c}.total").alias("total")) for c in e.columns))).alias("x")).select("x.*")


def spearman_matrix(spark: SparkSession, d: str) -> DataFrame:
    e = X.encode_for_correlation(T.load_train_features(spark, d))
    names = e.columns
    return X.spearman(e, [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]).withColumn("rho", F.round("rho", 6))


def item_content(spark: SparkSession, d: str) -> DataFrame:
    out = item_content_features(T.load_item_features(spark, d).where("item_id IS NOT NULL").distinct())
    return out.withColumns({c: F.round(c, 6) for c in ("item_rating_reviews_count_log1p", "item_price_log1p")})


def item_features_priority(spark: SparkSession, d: str) -> DataFrame:
    """Features of all items, those of the corpus before those of the log."""
    return features_by_priority(T.load_item_features(spark, d).where("item_id IS NOT NULL"), T.load_train_item_feature_lookup(spark, d)).select("item_id", "item_category_id", "item_microcat_id", "item_location_id", "item_rating")


def train_item_lookup(spark: SparkSession, d: str) -> DataFrame:
    return T.load_train_item_feature_lookup(spark, d).select("item_id", "item_category_id", "item_location_id", "item_rating", "item_rating_reviews_count")


def _features(spark: SparkSession, d: str, queries: DataFrame, corpus: DataFrame, relevance: DataFrame) -> DataFrame:
    content = item_content_features(features_by_priority(T.load_item_features(spark, d).where("item_id IS NOT NULL"), T.load_train_item_feature_lookup(spark, d)))
    flags = queries.select("query_id", F.col("search_is_delivery_search").cast("int").alias("search_is_delivery_search"))
    return C.generate_labelled(queries.select("query_id", *T.QUERY_COLUMNS), corpus.drop("origin"), content, relevance, flags, CONFIG)


def feature_table_query(spark: SparkSession, d: str) -> DataFrame:
    """The validation queries' feature table in sums by query."""
    v, corpus, relevance = _evaluation(spark, d)
    f = _features(spark, d, v, corpus, relevance)
    known = [F.count(c).alias(f"n_{c}") for c in ("item_rating", "item_rating_reviews_count_log1p", "item_price_log1p", "search_is_delivery_search")]
    return f.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("long").alias("n_relevant"), F.sum("item_is_phone_hidden").cast("long").alias("n_hidden"), *known)


_LINEAR = {"text_coverage_score": 2.0, "params_coverage_score": 1.0, "rrf_score": 10.0}


def rerank_topk(spark: SparkSession, d: str) -> DataFrame:
    """All logged candidates of a query reranked by a fixed linear score; the best 50, ties by fused score."""
    df = with_rank_terms(_logged_scores(spark, d), "query_id", "item_id", list(SCORES)).withColumn("rrf_score", fused_score(list(SCORES), [1.0] * 5))
    return R.rerank(R.linear_score(df, _LINEAR).withColumn("score", F.round("score", 9)), "score", TOP_K, [F.col("rrf_score").desc(), F.col("item_id")])


def rrf_baseline(spark: SparkSession, d: str) -> DataFrame:
    """The first 50 by the logged rank, best row of each pair."""
    rows = T.table(spark, d, "candidates").where("query_id IS NOT NULL AND item_id IS NOT NULL AND rrf_rank <= 50")
    return rows.groupBy("query_id", "item_id").agg(F.min("rrf_rank").alias("rank"))


def baseline_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Recall of the fused order and of a fixed linear reranking on the validation queries."""
    v, corpus, relevance = _evaluation(spark, d)
    found = cut_lineage(C.generate_with_features(v.select("query_id", *T.QUERY_COLUMNS), corpus.drop("origin"), CONFIG))
    again = R.rerank(R.linear_score(found, _LINEAR).withColumn("score", F.round("score", 9)), "score", TOP_K)
    return V.baseline_comparison(found, again, relevance).withColumn("recall", F.round("recall", 9))


def build_answer(spark: SparkSession, d: str) -> DataFrame:
    predictions = rerank_topk(spark, d)
    return U.build_answer(predictions, _queries(spark, d).where("query_id IS NOT NULL"), TOP_K)


def validate_answer(spark: SparkSession, d: str) -> DataFrame:
    """Checks an answer with planted faults."""
    answer = build_answer(spark, d)
    h = F.pmod(F.conv(F.substring(F.md5("query_id"), 1, 4), 16, 10).cast("int"), F.lit(10))
    faulty = answer.select(
        "query_id",
        F.when(h == 0, F.concat("answer", F.lit(" xyz"))).when(h == 1, F.concat("answer", F.lit(" 0000000000000000"))).when((h == 2) & (F.col("answer") != ""), F.concat_ws(" ", "answer", "answer")).otherwise(F.col("answer")).alias("answer"),
    ).where(h != 3)
    faulty = faulty.unionByName(faulty.where(h == 4))
    out = U.validate_answer(cut_lineage(faulty), _queries(spark, d).where("query_id IS NOT NULL"), _items(spark, d), TOP_K)
    return out.select("code", "n", F.array_join("examples", "|").alias("examples"))


def _training(spark: SparkSession, d: str, labels: DataFrame, v: DataFrame) -> DataFrame:
    """The feature table of all reachable training queries."""
    log, items = _train(spark, d), _items(spark, d)
    t = cut_lineage(L.training_queries(labels, v, log, items, None))
    known = cut_lineage(L.long_relevance(t, log))
    return cut_lineage(_features(spark, d, t, L.evaluation_corpus(items, log, known), known))


def _held_out(spark: SparkSession, d: str, v: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Relevance and feature table of the validation queries."""
    log = _train(spark, d)
    wanted = cut_lineage(L.long_relevance(v, log))
    return wanted, cut_lineage(_features(spark, d, v, L.evaluation_corpus(_items(spark, d), log, wanted), wanted))


def ltr_train_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Recall@50 of the trained ranker and of the fused order on the validation queries."""
    v = _validation(labels := _labels(spark, d))
    weights = R.train_pairwise(_training(spark, d, labels, v), FEATURE_COLUMNS)
    relevance, f = _held_out(spark, d, v)
    again = R.rerank(R.apply_pairwise(f, FEATURE_COLUMNS, weights), "score", TOP_K)
    return V.baseline_comparison(f, again, relevance)


def ltr_listwise(spark: SparkSession, d: str) -> DataFrame:
    """Recall@50 of boosting with a listwise loss, stopped early by the validation queries, and of the fused order there."""
    v = _validation(labels := _labels(spark, d))
    train = _training(spark, d, labels, v)
    relevance, f = _held_out(spark, d, v)
    again = R.rerank(R.train_listwise(train, FEATURE_COLUMNS, f).score(f), "score", TOP_K)
    return V.baseline_comparison(f, again, relevance)


def ltr_importance(spark: SparkSession, d: str) -> DataFrame:
    labels = _labels(spark, d)
    train = _training(spark, d, labels, _validation(labels))
    return R.importance(R.train_pairwise(train, FEATURE_COLUMNS), train)


_QUERIES = (
    tokenize_docs, tokenize_lemmas, embedding_cache, vocab_distinct, text_coverage, params_coverage_exact, semantic_match_matrix, params_coverage_semantic, dense_similarity_topk, location_centroids, location_signal,
    microcat_centroids, microcat_score, avg_rank_ties, rrf_fusion, rrf_weighted, rrf_constant_skip, category_filter_branches, candidates_topk, candidates_with_features, candidates_packed,
    relevance_labels, relevance_long, sample_queries, eval_corpus, train_split_reachable, recall_per_query, recall_at_k, relevant_item_coverage, ablation, threshold_calibration, params_calibration, split_overlap,
    location_match_rate, location_match_by_group, category_agreement, location_dispersion, propensity_binary, propensity_numeric, missing_rates, value_counts, nunique_grouped, nunique_global,
    describe_stats, hist_density, encode_correlation, spearman_matrix, item_content, item_features_priority, train_item_lookup, feature_table_query, rerank_topk, rrf_baseline,
    baseline_comparison, build_answer, validate_answer, ltr_train_rerank, ltr_listwise, ltr_importance,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in _QUERIES}


