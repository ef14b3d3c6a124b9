"""Queries of the training-data operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import neardup, overlap, packing, pii, residue, splits, tokenizer, topn
from quern.plans.lineage import cut_lineage

ITEM_TEXTS = ["item_title_raw", "item_description_raw", "item_infm_params_text"]
PII_FIELDS = ["item_title_raw", "item_description_raw"]
SEARCH = ["search_query", "search_infm_params_text", "search_category"]

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    rows = splits.search_components(_read(spark, d, "train").select("interaction_id", *SEARCH))
    return splits.assign_splits(rows, _read(spark, d, "split_plan"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.variant_pairs(_assigned(spark, d), "interaction_id", SEARCH)


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    """Every interaction's split."""
    return _assigned(spark, d).select("interaction_id", "split_name").distinct()


def p1_shares(spark: SparkSession, d: str) -> DataFrame:
    """Rows, components and share of each split."""
    done = _assigned(spark, d).groupBy("split_name", "component").agg(F.count(F.lit(1)).alias("n"))
    done = done.groupBy("split_name").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_components"))
    return done.join(F.broadcast(done.agg(F.sum("n_rows").alias("total"))), F.lit(True)).select("split_name", "n_rows", "n_components", F.round(100 * F.col("n_rows") / F.col("total"), 3).alias("percent"))


def p1_checked(spark: SparkSession, d: str) -> DataFrame:
    """Rows and components with a split, and components that are in two: none."""
    done = _assigned(spark, d).groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("split_name").alias("a"), F.max("split_name").alias("b"))
    torn = F.coalesce(F.sum((F.col("a") != F.col("b")).cast("long")), F.lit(0).cast("long"))
    return done.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_components"), torn.alias("n_torn"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.personal_data(_read(spark, d, "benchmark_items"), "item_id", PII_FIELDS)


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    """All items with typed placeholders in place of personal data."""
    return pii.redact(_read(spark, d, "benchmark_items").select("item_id", *PII_FIELDS), PII_FIELDS)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_n(_read(spark, d, "candidates"), "query_id", "item_id", "rrf_score", 10).select("query_id", "item_id")


def p5_ranked(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_n(_read(spark, d, "candidates"), "query_id", "item_id", "rrf_score", 10)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.cross_split_pairs(_read(spark, d, "benchmark_queries"), _read(spark, d, "train"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(_read(spark, d, "benchmark_queries"), _read(spark, d, "train"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_pairs(_read(spark, d, "benchmark_items"), "item_id", ITEM_TEXTS)


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_groups(_read(spark, d, "benchmark_items"), "item_id", ITEM_TEXTS)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.token_ids(_read(spark, d, "documents"), ["doc_id"], "text")


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Documents, and how many of them decode to their own text."""
    docs = _read(spark, d, "documents")
    back = tokenizer.decoded(tokenizer.token_ids(docs.withColumn("own", F.coalesce("text", F.lit(""))), ["own"], "text"), ["own"])
    return back.agg(F.count(F.lit(1)).alias("n_documents"), F.coalesce(F.sum((F.col("own") == F.col("text")).cast("long")), F.lit(0)).alias("n_equal"))


def _packs(spark: SparkSession, d: str) -> DataFrame:
    counts = tokenizer.token_counts(_read(spark, d, "documents"), ["doc_id"], "text")
    return packing.pack_items(counts, _read(spark, d, "pack_sizes"))


def p9_packs(spark: SparkSession, d: str) -> DataFrame:
    return _packs(spark, d)


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(_packs(spark, d), _read(spark, d, "pack_sizes"))


def p9_checked(spark: SparkSession, d: str) -> DataFrame:
    """Per capacity the packed documents, tokens lost or won, packs above the capacity, and documents torn though they fit."""
    counts = tokenizer.token_counts(_read(spark, d, "documents"), ["doc_id"], "text")
    sizes = _read(spark, d, "pack_sizes").select("pack_name", "capacity_tokens")
    packs = cut_lineage(_packs(spark, d))
    total = counts.agg(F.sum("n_tokens").alias("all"))
    docs = packs.groupBy("pack_name", "doc_id").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("pieces")).join(F.broadcast(sizes), "pack_name")
    docs = docs.groupBy("pack_name").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("t").alias("t"), F.sum(((F.col("pieces") > 1) & (F.col("t") <= F.col("capacity_tokens"))).cast("long")).alias("n_torn"))
    full = packs.where("pack IS NOT NULL").groupBy("pack_name", "block", "pack").agg(F.sum("n_tokens").alias("t")).join(F.broadcast(sizes), "pack_name")
    full = full.groupBy("pack_name").agg(F.sum((F.col("t") > F.col("capacity_tokens")).cast("long")).alias("n_over"))
    return docs.join(full, "pack_name").join(F.broadcast(total), F.lit(True)).select("pack_name", "n_documents", (F.col("all") - F.col("t")).alias("n_lost"), "n_over", "n_torn")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_documents(_read(spark, d, "documents"))


def p10_kept(spark: SparkSession, d: str) -> DataFrame:
    return residue.clean_documents(_read(spark, d, "documents")).select("doc_id", "source", "lang")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_splits, p1_shares, p1_checked, p4_found, p4_redacted, p5_found, p5_ranked, p6_found, p6_report, p7_found, p7_groups, p8_ids, p8_round_trip, p9_packs, p9_fill, p9_checked, p10_found, p10_kept)}


def _words(c: str) -> str:
    return f"regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}\\p{{N}}]+')"


def _shaped(c: str) -> str:
    return f"regexp_extract_all(translate(lower(coalesce({c}, '')), 'ёaceopxy', 'еасеорху'), '[\\p{{L}}\\p{{N}}]+')"


_BAG = "array_to_string(list_sort({}), ' ')"

_P1 = f"""
WITH t AS (
  SELECT DISTINCT interaction_id AS i, search_category AS c, search_query AS q, search_infm_params_text AS p,
         {_BAG.format(_shaped("search_query"))} AS bq, {_BAG.format(_shaped("search_infm_params_text"))} AS bp
  FROM train WHERE interaction_id IS NOT NULL)
SELECT DISTINCT a.i AS interaction_id_a, b.i AS interaction_id_b
FROM t a JOIN t b ON a.c IS NOT DISTINCT FROM b.c AND a.bq = b.bq AND a.bp = b.bp AND a.i < b.i
WHERE a.q IS DISTINCT FROM b.q OR a.p IS DISTINCT FROM b.p
"""

_P5 = """
WITH best AS (
  SELECT query_id, item_id, max(rrf_score) AS rrf_score FROM candidates
  WHERE query_id IS NOT NULL AND item_id IS NOT NULL AND rrf_score IS NOT NULL AND NOT isnan(rrf_score) GROUP BY 1, 2)
SELECT query_id, item_id, rrf_score, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, item_id) AS position
FROM best QUALIFY position <= 10
"""

# DuckDB compares bytes: lower-case Cyrillic letters are mapped to signs of one byte that normalised texts don't have.
_ONE_BYTE = "translate({}, 'абвгдежзийклмнопрстуфхцчшщъыьэюя', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ[]{{}}<>')"

_P6 = f"""
WITH q AS (
  SELECT DISTINCT query_id, array_to_string({_shaped("x")}, ' ') AS t, {_BAG.format(_shaped("x"))} AS b
  FROM (SELECT query_id, search_query AS x FROM benchmark_queries UNION ALL SELECT query_id, search_infm_params_text FROM benchmark_queries)
  WHERE query_id IS NOT NULL),
r AS (SELECT DISTINCT interaction_id, array_to_string({_shaped("search_query")}, ' ') AS t FROM train WHERE interaction_id IS NOT NULL),
qt AS (SELECT DISTINCT t, b FROM q WHERE t <> ''),
rt AS (SELECT DISTINCT t, array_to_string(list_sort(string_split(t, ' ')), ' ') AS b FROM r WHERE t <> ''),
m AS (
  SELECT qt.t AS a, rt.t AS z FROM qt JOIN rt ON qt.b = rt.b
  UNION
  SELECT qt.t, rt.t FROM qt JOIN rt ON abs(length(qt.t) - length(rt.t)) <= 2 AND levenshtein({_ONE_BYTE.format("qt.t")}, {_ONE_BYTE.format("rt.t")}) <= 2)
SELECT DISTINCT query_id, interaction_id FROM m JOIN q ON q.t = m.a JOIN r ON r.t = m.z
"""

_P6_REPORT = f"""
WITH q AS (
  SELECT DISTINCT query_id, eval_split, source, array_to_string({_shaped("x")}, ' ') AS t, {_BAG.format(_shaped("x"))} AS b
  FROM (SELECT query_id, eval_split, source, search_query AS x FROM benchmark_queries UNION ALL SELECT query_id, eval_split, source, search_infm_params_text FROM benchmark_queries)
  WHERE query_id IS NOT NULL),
r AS (SELECT t, count(*) AS n, array_to_string(list_sort(string_split(t, ' ')), ' ') AS b FROM (SELECT DISTINCT interaction_id, array_to_string({_shaped("search_query")}, ' ') AS t FROM train WHERE interaction_id IS NOT NULL) WHERE t <> '' GROUP BY t),
qt AS (SELECT DISTINCT t, b FROM q WHERE t <> ''),
m AS (
  SELECT qt.t AS a, r.t AS z, r.n, true AS same FROM qt JOIN r ON qt.b = r.b
  UNION ALL
  SELECT qt.t, r.t, r.n, false FROM qt JOIN r ON abs(length(qt.t) - length(r.t)) <= 2 AND qt.b <> r.b AND levenshtein({_ONE_BYTE.format("qt.t")}, {_ONE_BYTE.format("r.t")}) <= 2),
h AS (SELECT query_id, eval_split, source, z, max(n) AS n, bool_or(same) AS same FROM q JOIN m ON m.a = q.t GROUP BY 1, 2, 3, 4),
g AS (SELECT query_id, eval_split, source, sum(n) AS n, bool_or(same) AS same FROM h GROUP BY 1, 2, 3),
e AS (SELECT DISTINCT query_id, eval_split, source FROM benchmark_queries WHERE query_id IS NOT NULL)
SELECT e.eval_split, e.source, count(*) AS n_queries, count(g.query_id) AS n_overlapping, coalesce(sum(g.same::INT), 0)::BIGINT AS n_exact, coalesce(sum(g.n), 0)::BIGINT AS n_interactions
FROM e LEFT JOIN g ON g.query_id = e.query_id AND g.eval_split IS NOT DISTINCT FROM e.eval_split AND g.source IS NOT DISTINCT FROM e.source GROUP BY 1, 2
"""

_P7 = f"""
WITH d AS (
  SELECT DISTINCT item_id, list_sort(list_distinct({_words("concat_ws(chr(10), item_title_raw, item_description_raw, item_infm_params_text)")})) AS w
  FROM benchmark_items WHERE item_id IS NOT NULL),
s AS (SELECT row_number() OVER (ORDER BY item_id, w) AS k, item_id, len(w) AS n, w FROM d WHERE len(w) >= 25),
x AS (SELECT k, item_id, n, unnest(w) AS word FROM s),
o AS (SELECT a.item_id AS ia, b.item_id AS ib, a.n AS na, b.n AS nb, count(*) AS c FROM x a JOIN x b ON a.word = b.word AND a.item_id < b.item_id GROUP BY a.k, b.k, 1, 2, 3, 4)
SELECT DISTINCT ia AS item_id_a, ib AS item_id_b FROM o WHERE c * 10 >= (na + nb - c) * 7
"""


_P7_GROUPS = f"""
WITH RECURSIVE d AS (
  SELECT DISTINCT item_id, list_sort(list_distinct({_words("concat_ws(chr(10), item_title_raw, item_description_raw, item_infm_params_text)")})) AS w
  FROM benchmark_items WHERE item_id IS NOT NULL),
c AS MATERIALIZED (SELECT row_number() OVER (ORDER BY w) AS k, w, len(w) AS n FROM (SELECT DISTINCT w FROM d WHERE len(w) >= 25)),
m AS MATERIALIZED (SELECT item_id, k FROM d JOIN c USING (w)),
x AS (SELECT k, n, unnest(w) AS word FROM c),
l AS MATERIALIZED (SELECT a.k AS a, b.k AS b FROM x a JOIN x b ON a.word = b.word AND a.k <> b.k GROUP BY a.k, b.k, a.n, b.n HAVING count(*) * 10 >= (a.n + b.n - count(*)) * 7),
r AS (SELECT k AS s, k AS t FROM c UNION SELECT r.s, l.b FROM r JOIN l ON l.a = r.t),
g AS (SELECT s AS k, min(t) AS root FROM r GROUP BY 1),
f AS (SELECT root, min(item_id) AS group_id FROM m JOIN g USING (k) GROUP BY 1),
n AS (SELECT a AS k, count(*) AS n_links FROM l GROUP BY 1)
SELECT m.item_id, f.group_id, coalesce(n.n_links, 0)::BIGINT AS n_links FROM m JOIN g USING (k) JOIN f USING (root) LEFT JOIN n USING (k)
"""

_P1_CHECKED = f"""
SELECT count(*) AS n_rows, count(DISTINCT (c, bq, bp)) AS n_components, 0::BIGINT AS n_torn FROM (
  SELECT coalesce(search_category::VARCHAR, '') AS c, {_BAG.format(_shaped("search_query"))} AS bq, {_BAG.format(_shaped("search_infm_params_text"))} AS bp FROM train)
"""


def oracle_sql() -> dict[str, str]:
    return {"p1_checked": _P1_CHECKED, "p7_groups": _P7_GROUPS, "p9_checked": "SELECT pack_name, (SELECT count(*) FROM documents) AS n_documents, 0::BIGINT AS n_lost, 0::BIGINT AS n_over, 0::BIGINT AS n_torn FROM pack_sizes", "p1_found": _P1, "p5_found": f"SELECT query_id, item_id FROM ({_P5})", "p5_ranked": _P5, "p6_found": _P6, "p6_report": _P6_REPORT, "p7_found": _P7, "p8_round_trip": "SELECT count(*) AS n_documents, count(*) AS n_equal FROM documents"}
