"""Candidate generation: category filter, five signals, fusion, top k.

``generate*`` rank in blocks, without a table of all pairs (``blocks``). ``category_pairs`` and ``score_pairs`` form the pairs
one by one, for small sets of queries and for other signals in place of the five.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.config import SCORES, GeneratorConfig
from quern.functions.text import Tokenizer, tokens
from quern.functions.vectors import hash_embedding, with_hash_vectors
from quern.operators import signals as S
from quern.operators.blocks import BlockRanker
from quern.operators.fusion import fused_score, top_by, with_rank_terms
from quern.plans.lineage import cut_lineage
from quern.plans.skew import spread

#: Relevant items that a query brings along as a list; of queries with more, workers look their candidates up in a table.
LISTED = 1000


def prepare_items(items: DataFrame, embed=hash_embedding, tokenizer: Tokenizer = tokens) -> DataFrame:
    """Distinct items with an id, their distinct tokens and their embedding, and in ``params_read`` the params tokens that are
    embedded: of an id with several rows the least tokens count."""
    # Tokens cost far more than the rows' bytes tell, so adaptive coalescing is kept from gathering the rows.
    base = spread(items.where("item_id IS NOT NULL"), "item_id").distinct()
    base = base.withColumns({"params_tokens": S.distinct_tokens(F.col("item_infm_params_text"), tokenizer), "text_tokens": S.item_text_tokens(tokenizer)})
    one = Window.partitionBy("item_id")
    base = base.drop("item_title_raw", "item_description_raw", "item_infm_params_text").withColumn("params_read", F.min("params_tokens").over(one))
    if embed is hash_embedding:
        return with_hash_vectors(base.withColumn("_read", F.min("text_tokens").over(one)), "_read").drop("_read")
    base = cut_lineage(base)
    vectors = embed(base.groupBy("item_id").agg(F.min("text_tokens").alias("text_tokens")), "item_id", "text_tokens")
    return base.join(vectors, "item_id", "left")


def prepare_queries(queries: DataFrame, embed=hash_embedding, tokenizer: Tokenizer = tokens) -> DataFrame:
    """Distinct query rows with an id, numbered by ``uid``, their distinct tokens and their embedding. Rows of one id that
    differ are queries of their own."""
    base = queries.where("query_id IS NOT NULL").distinct().withColumn("uid", F.monotonically_increasing_id())
    base = cut_lineage(base.withColumns({"q_params": S.distinct_tokens(F.col("search_infm_params_text"), tokenizer), "q_text": S.distinct_tokens(F.col("search_query"), tokenizer)}))
    if embed is hash_embedding:
        return with_hash_vectors(base.drop("search_query", "search_infm_params_text"), "q_text", name="q_embedding")
    vectors = embed(base.select("uid", "q_text"), "uid", "q_text", name="q_embedding")
    return base.join(vectors, "uid", "left").drop("search_query", "search_infm_params_text")


def query_categories(queries: DataFrame, items: DataFrame, unspecified: int = 0) -> DataFrame:
    """Adds ``filter_category``: the category to which a query is confined, null where it is open to all items: category
    unspecified or null, or without any item."""
    known = items.select(F.col("item_category_id").alias("c")).where("c IS NOT NULL").distinct()
    joined = queries.join(known, (queries["search_category"] == F.col("c")) & (queries["search_category"] != unspecified), "left")
    return joined.withColumn("filter_category", F.col("c")).drop("c")


def category_sizes(queries: DataFrame, items: DataFrame, unspecified: int = 0) -> DataFrame:
    """``query_categories`` and ``n_items``, how many items are behind each query's filter, from counts by category."""
    counts = items.groupBy(F.col("item_category_id").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    joined = query_categories(queries, items, unspecified).join(counts, F.col("filter_category") == F.col("c"), "left").join(F.broadcast(total), F.lit(True))
    return joined.withColumn("n_items", F.when(F.col("filter_category").isNull(), F.col("total")).otherwise(F.col("n"))).drop("c", "n", "total")


def category_pairs(queries: DataFrame, items: DataFrame, config: GeneratorConfig = GeneratorConfig()) -> DataFrame:
    """All (query, item) pairs behind the category filter, as two equi-joins on salted keys: for small sets of queries.

    Nearly all items may be of one category, so items are cut into chunks and queries repeated for each chunk.
    """
    n = config.pair_chunks
    q = query_categories(queries, items, config.unspecified_category_value).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    i = items.withColumn("chunk", F.pmod(F.xxhash64("item_id"), F.lit(n)).cast("int"))
    i = i.withColumns({"in_category": F.xxhash64("item_category_id", "chunk"), "in_chunk": F.xxhash64("chunk")})
    confined = q.where("filter_category IS NOT NULL").withColumn("in_category", F.xxhash64("filter_category", "chunk")).drop("chunk")
    confined = spread(confined, "in_category").join(spread(i.drop("chunk", "in_chunk"), "in_category"), "in_category")
    confined = confined.where(F.col("filter_category") == F.col("item_category_id")).drop("in_category")
    free = q.where("filter_category IS NULL").withColumn("in_chunk", F.xxhash64("chunk")).drop("chunk")
    return confined.unionByName(spread(free, "in_chunk").join(spread(i.drop("chunk", "in_category"), "in_chunk"), "in_chunk").drop("in_chunk"))


def score_pairs(queries: DataFrame, items: DataFrame, config: GeneratorConfig = GeneratorConfig(), text_score: Column | DataFrame | None = None, semantic: DataFrame | None = None) -> DataFrame:
    """``uid, query_id, item_id``, the five scores (float) and ``location_distance_km`` for all pairs behind the filter.

    ``queries`` and ``items`` as from ``prepare_*``. ``semantic`` (token, item_id) extends the coverage of params.
    ``text_score`` replaces text coverage: a column over the pair's columns, or a frame (query_id, item_id, score) in which
    missing pairs score 0. Centroids come from all items.
    """
    places = S.location_centroids(items).withColumnRenamed("location_id", "_loc")
    q = queries.join(places, queries["search_location_id"] == places["_loc"], "left").drop("_loc").withColumn("q_sparse", S.nonzero(F.col("q_embedding")))
    items = with_semantic(items, semantic)
    centroids = S.microcat_centroids(items).select(F.col("item_microcat_id").alias("_mc"), "centroid")
    pairs = category_pairs(q, items.join(centroids, F.col("item_microcat_id").eqNullSafe(F.col("_mc")), "left").drop("_mc"), config)
    if isinstance(text_score, DataFrame):
        pairs = pairs.join(text_score.groupBy("query_id", "item_id").agg(F.max("score").cast("float").alias("_text")), ["query_id", "item_id"], "left")
        text_score = F.coalesce("_text", F.lit(0.0))
    place = [F.col(c) for c in ("search_location_id", "centroid_lat", "centroid_lon", "item_location_id")] + [F.col("item_latitude").cast("double"), F.col("item_longitude").cast("double")]
    return pairs.select(
        "uid",
        "query_id",
        "item_id",
        S.coverage(F.col("q_params"), F.col("params_tokens")).alias("params_coverage_score"),
        (S.coverage(F.col("q_text"), F.col("text_tokens")) if text_score is None else text_score.cast("float")).alias("text_coverage_score"),
        S.sparse_similarity(F.col("q_sparse"), F.col("embedding")).alias("text_similarity_score"),
        S.location_match(*place, decay_km=config.location_decay_km).alias("location_match_score"),
        S.location_distance_km(*place).cast("float").alias("location_distance_km"),
        S.sparse_similarity(F.col("q_sparse"), F.col("centroid")).alias("microcat_match_score"),
    )


def with_semantic(items: DataFrame, semantic: DataFrame | None) -> DataFrame:
    """``items`` whose params tokens include their matches by meaning: ``semantic`` (token, item_id)."""
    if semantic is None:
        return items
    found = semantic.groupBy("item_id").agg(F.collect_set("token").alias("_more"))
    both = F.array_union("params_tokens", F.coalesce("_more", F.array().cast("array<string>")))
    return items.join(found, "item_id", "left").withColumn("params_tokens", both).drop("_more")


def params_matches(queries: DataFrame, items: DataFrame, config: GeneratorConfig = GeneratorConfig(), embed=hash_embedding) -> DataFrame:
    """``token, item_id``: params tokens of ``queries`` whose embedding is near that of an item's params.

    ``queries`` and ``items`` as from ``prepare_*``. Tokens of no query can't be found, so they aren't compared.
    """
    vocabulary = queries.select(F.explode("q_params").alias("token")).distinct().withColumn("ts", F.array("token"))
    texts = items.groupBy("item_id").agg(F.min("params_tokens").alias("ts"))
    return S.semantic_matches(embed(vocabulary, "token", "ts"), embed(texts, "item_id", "ts"), "item_id", config.params_similarity_threshold)


def best_items(queries: DataFrame, items: DataFrame, config: GeneratorConfig, weightings: list[list[float]], semantic: DataFrame | None = None, lists: bool = False, carried: list[str] = [], said: list[str] = [], known: DataFrame | None = None) -> DataFrame:
    """The ``config.top_k`` best items of each query row under each weighting (``variant`` is its place), with ``query_id``;
    as rows, or with ``lists`` as one list of ids a query.

    ``queries`` and ``items`` as from ``prepare_*``, written once. ``semantic`` (token, item_id) extends the coverage of
    params; null stands for the matches with ``config.params_similarity_threshold``. No pair table is formed. For ``carried``,
    ``said``, ``known`` and labels see ``BlockRanker``.
    """
    places = S.location_centroids(items).withColumnRenamed("location_id", "_loc")
    q = query_categories(queries, items, config.unspecified_category_value)
    q = cut_lineage(q.join(places, q["search_location_id"] == places["_loc"], "left").drop("_loc"))
    centroids = cut_lineage(S.microcat_centroids(items).select("item_microcat_id", "centroid"))
    i = with_semantic(items, semantic)
    i = i.withColumns({"lat": F.col("item_latitude").cast("double"), "lon": F.col("item_longitude").cast("double")}).withColumnsRenamed({"params_tokens": "params", "text_tokens": "texts"})
    asked = None
    if semantic is None:
        vocabulary = queries.select(F.explode("q_params").alias("token")).distinct().withColumn("_ts", F.array("token"))
        asked = cut_lineage(with_hash_vectors(vocabulary, "_ts").drop("_ts"))
    return BlockRanker(q, i, centroids, weightings, config.top_k, config.rrf_k, config.location_decay_km, asked, config.params_similarity_threshold, carried, said, known).run(lists)


def generate_with_features(queries: DataFrame, items: DataFrame, config: GeneratorConfig = GeneratorConfig(), semantic: DataFrame | None = None, text_score: Column | DataFrame | None = None) -> DataFrame:
    """The best ``config.top_k`` items of each query with all scores, ``rrf_score`` and ``rrf_rank`` (from 1).

    Equal fused scores go to the smaller item id. Raw ``benchmark_queries`` and ``benchmark_items`` rows are accepted;
    repeated rows count once, rows without id don't count, and rows of one query id that differ are ranked apart. Params are
    also matched by meaning, with ``config.params_similarity_threshold``, unless ``semantic`` (token, item_id) gives other
    matches. Another text signal (``text_score``, see ``score_pairs``) is scored pair by pair.
    """
    tokenizer = lambda c: tokens(c, min_len=config.min_token_len)
    i = cut_lineage(prepare_items(items, tokenizer=tokenizer))
    q = cut_lineage(prepare_queries(queries, tokenizer=tokenizer))
    if text_score is None:
        best = best_items(q, i, config, [config.weights()], semantic)
    else:
        scored = score_pairs(q, i, config, text_score, params_matches(q, i, config) if semantic is None else semantic)
        ranked = with_rank_terms(scored, "uid", "item_id", list(SCORES))
        best = top_by(ranked.withColumn("rrf_score", fused_score(list(SCORES), config.weights(), config.rrf_k)), "uid", "rrf_score", "item_id", config.top_k)
    return best.select("query_id", "item_id", *SCORES, "location_distance_km", "rrf_score", "rrf_rank")


def generate_labelled(queries: DataFrame, items: DataFrame, content: DataFrame, relevance: DataFrame, flags: DataFrame, config: GeneratorConfig = GeneratorConfig()) -> DataFrame:
    """``feature_table(generate_with_features(queries, items), content, relevance, flags)``, made where the items are ranked, so
    that no candidate is shuffled: content comes along with the items, flags and relevant items with the queries.

    ``content`` and ``flags`` have one row per key; a query may have any number of relevant items.
    """
    tokenizer = lambda c: tokens(c, min_len=config.min_token_len)
    i = cut_lineage(prepare_items(items, tokenizer=tokenizer).join(content, "item_id", "left"))
    few, many = listed(relevance)
    lists = few.groupBy("query_id").agg(F.collect_set("item_id").alias("relevant"))
    q = prepare_queries(queries, tokenizer=tokenizer).drop(*(c for c in flags.columns if c != "query_id"))
    q = cut_lineage(q.join(flags, "query_id", "left").join(lists, "query_id", "left"))
    carried, said = ([c for c in df.columns if c != key] for df, key in ((content, "item_id"), (flags, "query_id")))
    best = best_items(q, i, config, [config.weights()], carried=carried, said=said, known=many)
    return best.select("query_id", "item_id", *SCORES, "location_distance_km", "rrf_score", "rrf_rank", *carried, *said, "label")


def listed(relevance: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``query_id, item_id`` of the queries with up to ``LISTED`` relevant items, and of the others, written in ranges of
    both; None if there are none."""
    pairs = relevance.where("item_id IS NOT NULL").select("query_id", "item_id")
    hot = cut_lineage(pairs.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LISTED))
    n = hot.agg(F.sum("n")).first()[0]
    if not n:
        return pairs, None
    many = pairs.join(hot.select("query_id"), "query_id", "left_semi").repartitionByRange(-(-n // 100_000), "query_id", "item_id")
    return pairs.join(hot.select("query_id"), "query_id", "left_anti"), cut_lineage(many)


def generate(queries: DataFrame, items: DataFrame, config: GeneratorConfig = GeneratorConfig(), **kwargs) -> DataFrame:
    """``query_id, item_id, rrf_rank`` only. Of differing rows of one query id one counts: as rows have no order, the
    greatest by its columns."""
    return generate_with_features(_one_each(queries), items, config, **kwargs).select("query_id", "item_id", "rrf_rank")


def _one_each(queries: DataFrame) -> DataFrame:
    rest = [c for c in queries.columns if c != "query_id"]
    return queries.groupBy("query_id").agg(F.max(F.struct(*rest)).alias("_row")).select("query_id", "_row.*")


def generate_packed(queries: DataFrame, items: DataFrame, config: GeneratorConfig = GeneratorConfig()) -> DataFrame:
    """``packed(generate(...))``, whose lists are made where the items are ranked, so that no candidate is shuffled."""
    tokenizer = lambda c: tokens(c, min_len=config.min_token_len)
    i = cut_lineage(prepare_items(items, tokenizer=tokenizer))
    q = cut_lineage(prepare_queries(_one_each(queries), tokenizer=tokenizer))
    best = best_items(q, i, config, [config.weights()], lists=True)
    return best.select("query_id", "candidate_item_ids", F.size("candidate_item_ids").cast("long").alias("n_candidates"))


def packed(candidates: DataFrame, rank: str = "rrf_rank") -> DataFrame:
    """``query_id, candidate_item_ids, n_candidates``: ids best first. A query has at most top_k candidates."""
    lists = candidates.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), "item_id"))).alias("x"))
    return lists.select("query_id", F.transform("x", lambda s: s["item_id"]).alias("candidate_item_ids"), F.size("x").cast("long").alias("n_candidates"))
