"""SQL of the search queries, for DuckDB on the same tables."""

from __future__ import annotations

from quern.config import SCORES
from quern.functions.text import STOPWORDS
from quern.operators.evaluate import THRESHOLDS, VARIANTS
from quern.ranking_queries import CONFIG, N_VALIDATION, SEMANTIC, TOP_K
from quern.sources.tables import ITEM_COLUMNS, QUERY_COLUMNS

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def _tokens(c: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all(coalesce({c}, ''), '[a-zA-Zа-яА-ЯёЁ0-9]+'), lambda t: lower(t)), lambda t: length(t) >= 2 AND t NOT IN ({_STOP}))"


def _distinct(c: str) -> str:
    """Distinct tokens; their order doesn't matter here."""
    return f"list_sort(list_distinct({_tokens(c)}))"


_TEXT = "concat(coalesce(item_title_raw, ''), ' ', coalesce(item_description_raw, ''))"
_ICOLS, _QCOLS = ", ".join(ITEM_COLUMNS), ", ".join(QUERY_COLUMNS)
_ITEMS = f"SELECT DISTINCT {_ICOLS} FROM benchmark_items WHERE item_id IS NOT NULL"
_QUERIES = f"SELECT DISTINCT query_id, {_QCOLS} FROM benchmark_queries WHERE query_id IS NOT NULL"


def _embedding(name: str, source: str, key: str, tokens: str) -> str:
    """CTEs that embed ``source(key, tokens)`` as ``name(key, e)``."""
    return f"""
{name}_t AS (SELECT {key} AS k, unnest({tokens}) AS t FROM {source}),
{name}_s AS (SELECT k, CAST('0x' || substr(md5(t), 1, 4) AS INTEGER) % 64 AS i, sum(CASE WHEN substr(md5(t), 5, 1) < '8' THEN 1 ELSE -1 END) AS v FROM {name}_t GROUP BY 1, 2),
{name}_d AS (SELECT x.k, list(coalesce(s.v, 0)::FLOAT ORDER BY r.i) AS d FROM (SELECT DISTINCT {key} AS k FROM {source}) x CROSS JOIN (SELECT unnest(range(64)) AS i) r LEFT JOIN {name}_s s ON s.k = x.k AND s.i = r.i GROUP BY x.k),
{name} AS (SELECT k AS {key}, {_unit("d")} AS e FROM {name}_d)"""


def _dot(a: str, b: str) -> str:
    return f"list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])"


def _unit(v: str) -> str:
    return f"list_transform({v}, lambda x: (x::DOUBLE / (CASE WHEN {_dot(v, v)} = 0 THEN 1.0 ELSE sqrt({_dot(v, v)}) END))::FLOAT)"


def _km(la1: str, lo1: str, la2: str, lo2: str) -> str:
    hlat, hlon = f"sin(radians({la2} - {la1}) / 2)", f"sin(radians({lo2} - {lo1}) / 2)"
    known = " AND ".join(f"{c} IS NOT NULL" for c in (la1, lo1, la2, lo2))
    return f"(CASE WHEN {known} THEN 2 * 6371.0 * asin(sqrt(least(1.0, greatest(0.0, {hlat} * {hlat} + cos(radians({la1})) * cos(radians({la2})) * {hlon} * {hlon})))) END)"


def _mean_unit(name: str, source: str, key: str, vector: str) -> str:
    """CTEs: ``name(key, c, n)``, the normalised mean vectors."""
    return f"""
{name}_p AS (SELECT {key} AS k, unnest({vector}) AS v, unnest(range(len({vector}))) AS i FROM {source}),
{name}_m AS (SELECT k, i, avg(v::DOUBLE) AS m, count(*) AS n FROM {name}_p GROUP BY 1, 2),
{name}_d AS (SELECT k, list(m ORDER BY i) AS d, max(n) AS n FROM {name}_m GROUP BY 1),
{name} AS (SELECT k AS {key}, {_unit("d")} AS c, n FROM {name}_d)"""


def _average_rank(s: str) -> str:
    return f"(rank() OVER (PARTITION BY query_id ORDER BY {s} DESC) + (count(*) OVER (PARTITION BY query_id, {s}) - 1) / 2.0)"


def _ranks(scores: list[str]) -> str:
    gate = lambda s: f"CASE WHEN min({s}) OVER (PARTITION BY query_id) <> max({s}) OVER (PARTITION BY query_id) THEN {_average_rank(s)} END AS r_{s}"
    return ", ".join(gate(s) for s in scores)


def _fuse(scores: list[str] | tuple[str, ...], weights: list[float] | tuple[float, ...]) -> str:
    return " + ".join(["0.0::DOUBLE", *(f"coalesce({w}::DOUBLE / (60 + r_{s}), 0.0::DOUBLE)" for s, w in zip(scores, weights) if w)])


_CENTROIDS = "SELECT item_location_id AS location_id, sum(item_latitude)::DOUBLE / count(*) AS clat, sum(item_longitude)::DOUBLE / count(*) AS clon FROM {} WHERE item_location_id IS NOT NULL AND item_latitude IS NOT NULL AND item_longitude IS NOT NULL GROUP BY 1"


def _scored(items: str, queries: str) -> str:
    """CTEs up to ``scored``: all pairs behind the category filter with five scores and the distance."""
    km = _km("q.clat", "q.clon", "i.la", "i.lo")
    return f"""
i0 AS MATERIALIZED (SELECT *, item_latitude::DOUBLE AS la, item_longitude::DOUBLE AS lo, {_distinct("item_infm_params_text")} AS p0, {_distinct(_TEXT)} AS tt FROM ({items})),
qu AS MATERIALIZED (SELECT *, {_distinct("search_infm_params_text")} AS qp, {_distinct("search_query")} AS qt FROM ({queries})),
pv AS (SELECT DISTINCT unnest(qp) AS token FROM qu),
{_embedding("pe", "(SELECT token, [token] AS ts FROM pv)", "token", "ts")},
{_embedding("pi", "(SELECT item_id, min(p0) AS ts FROM i0 GROUP BY 1)", "item_id", "ts")},
pm AS (SELECT pi.item_id, list(pe.token) AS more FROM pe CROSS JOIN pi WHERE {_dot("pe.e", "pi.e")}::FLOAT >= {CONFIG.params_similarity_threshold}::FLOAT GROUP BY 1),
it AS MATERIALIZED (SELECT i0.*, list_distinct(list_concat(p0, coalesce(more, []))) AS pt FROM i0 LEFT JOIN pm USING (item_id)),
{_embedding("ie", "(SELECT item_id, min(tt) AS tt FROM it GROUP BY 1)", "item_id", "tt")},
{_embedding("qe", "(SELECT query_id, min(qt) AS qt FROM qu GROUP BY 1)", "query_id", "qt")},
i2 AS MATERIALIZED (SELECT it.*, ie.e FROM it JOIN ie USING (item_id)),
ce AS ({_CENTROIDS.format("it")}),
{_mean_unit("mc", "i2", "item_microcat_id", "e")},
q2 AS MATERIALIZED (
  SELECT qu.*, qe.e, ce.clat, ce.clon, CASE WHEN search_category <> 0 AND search_category IN (SELECT item_category_id FROM it WHERE item_category_id IS NOT NULL) THEN search_category END AS fc
  FROM qu JOIN qe USING (query_id) LEFT JOIN ce ON ce.location_id = qu.search_location_id),
qm AS MATERIALIZED (SELECT query_id, item_microcat_id, {_dot("q2.e", "mc.c")}::FLOAT AS s FROM (SELECT DISTINCT query_id, e FROM q2) q2 CROSS JOIN mc),
scored AS MATERIALIZED (
  SELECT q.query_id, i.item_id,
    (CASE WHEN len(q.qp) > 0 THEN len(list_intersect(q.qp, i.pt))::DOUBLE / len(q.qp) ELSE 0.0 END)::FLOAT AS params_coverage_score,
    (CASE WHEN len(q.qt) > 0 THEN len(list_intersect(q.qt, i.tt))::DOUBLE / len(q.qt) ELSE 0.0 END)::FLOAT AS text_coverage_score,
    {_dot("q.e", "i.e")}::FLOAT AS text_similarity_score,
    (CASE WHEN q.search_location_id = i.item_location_id THEN 1.0::DOUBLE ELSE coalesce(exp(-{km} / 5.0), 0.0::DOUBLE) END)::FLOAT AS location_match_score,
    (CASE WHEN q.search_location_id = i.item_location_id THEN 0.0::DOUBLE ELSE {km} END)::FLOAT AS location_distance_km,
    coalesce(qm.s, 0.0::FLOAT) AS microcat_match_score
  FROM q2 q JOIN i2 i ON q.fc IS NULL OR q.fc = i.item_category_id
  LEFT JOIN qm ON qm.query_id = q.query_id AND qm.item_microcat_id IS NOT DISTINCT FROM i.item_microcat_id)"""


def _generated(items: str, queries: str, k: int) -> str:
    """CTEs up to ``best``: the top k of each query."""
    return f"""{_scored(items, queries)},
ranked AS (SELECT *, {_ranks(list(SCORES))} FROM scored),
fused AS (SELECT *, {_fuse(SCORES, (1.0,) * 5)} AS rrf_score FROM ranked),
best AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, item_id) AS rrf_rank FROM fused QUALIFY rrf_rank <= {k})"""


_FIRST = "first({c} ORDER BY interaction_id, ingested_at) FILTER (WHERE {c} IS NOT NULL) AS {c}"
_LABELS = f"""
SELECT format('train_{{:06d}}', row_number() OVER (ORDER BY search_query NULLS LAST, search_infm_params_text NULLS LAST, search_category NULLS LAST) - 1) AS query_id, * FROM (
  SELECT search_query, coalesce(search_infm_params_text, '') AS search_infm_params_text, search_category, {_FIRST.format(c="search_location_id")}, {_FIRST.format(c="search_is_delivery_search")},
    list_sort(list_distinct(list(item_id) FILTER (WHERE item_id IS NOT NULL))) AS ids, count(item_id) AS n_interactions, count(DISTINCT item_id) AS n_relevant
  FROM train GROUP BY search_query, coalesce(search_infm_params_text, ''), search_category)"""
_VALIDATION = f"SELECT * FROM lb WHERE coalesce(len(ids), 0) <= 200 ORDER BY md5('42|' || query_id), query_id LIMIT {N_VALIDATION}"
_EXTRA = f"""
SELECT {_ICOLS} FROM (SELECT {_ICOLS}, row_number() OVER (PARTITION BY item_id ORDER BY interaction_id, ingested_at) AS rn FROM train
  WHERE item_id IN (SELECT item_id FROM rel) AND item_id NOT IN (SELECT item_id FROM benchmark_items WHERE item_id IS NOT NULL)) WHERE rn = 1"""
_EVALUATION = f"""
lb AS MATERIALIZED ({_LABELS}),
va AS MATERIALIZED ({_VALIDATION}),
rel AS MATERIALIZED (SELECT DISTINCT query_id, unnest(ids) AS item_id FROM va)"""
_EVAL_ITEMS = f"SELECT DISTINCT * FROM (SELECT {_ICOLS} FROM benchmark_items WHERE item_id IS NOT NULL UNION ALL {_EXTRA})"
_EVAL_QUERIES = f"SELECT query_id, {_QCOLS} FROM va"


def _evaluated(k: int = 500) -> str:
    return f"WITH {_EVALUATION}, {_generated(_EVAL_ITEMS, _EVAL_QUERIES, k)}"


_KS = (50, 100, 200, 250, 500)
_RECALLS = f"""{_evaluated()},
pq AS (SELECT ks.k, rel.query_id, count(*) AS n_relevant, sum(CASE WHEN b.rrf_rank <= ks.k THEN 1 ELSE 0 END)::DOUBLE / count(*) AS recall
  FROM rel CROSS JOIN (SELECT unnest([{", ".join(map(str, _KS))}]::BIGINT[]) AS k) ks LEFT JOIN best b ON b.query_id = rel.query_id AND b.item_id = rel.item_id GROUP BY 1, 2)"""

_best = lambda c: f"coalesce(max(CASE WHEN NOT isnan({c}) THEN {c}::DOUBLE END), 0.0)::FLOAT AS {c}"
_LOGGED = f"lg AS MATERIALIZED (SELECT query_id, item_id, {', '.join(_best(c) for c in SCORES)} FROM candidates WHERE query_id IS NOT NULL AND item_id IS NOT NULL GROUP BY 1, 2)"


def _logged_fusion(scores: list[str], weights: list[float], extra: str = "*") -> str:
    return f"""WITH {_LOGGED}, r AS (SELECT *, {_ranks(scores)} FROM (SELECT {extra} FROM lg)), f AS (SELECT query_id, item_id, {_fuse(scores, weights)} AS fused FROM r)
SELECT query_id, item_id, round(fused, 9) AS fused, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, item_id) AS position FROM f QUALIFY position <= 20"""


def _sparse(query_text: str, item_text: str, semantic: bool = False) -> str:
    head = f"""WITH q AS (SELECT DISTINCT query_id, qt FROM (SELECT query_id, {_distinct(query_text)} AS qt FROM ({_QUERIES}))),
w AS (SELECT query_id, len(qt) AS n, unnest(qt) AS token FROM q),
p AS (SELECT DISTINCT item_id, unnest({_distinct(item_text)}) AS token FROM ({_ITEMS}))"""
    found = "p"
    if semantic:
        head += f", {_SEMANTIC}, ps AS (SELECT item_id, token FROM p UNION SELECT item_id, token FROM sm)"
        found = "ps"
    return f"""{head}, s AS (SELECT w.query_id, x.item_id, (count(DISTINCT w.token)::DOUBLE / max(w.n))::FLOAT AS score FROM w JOIN {found} x USING (token) GROUP BY w.query_id, w.n, x.item_id)
SELECT query_id, count(*) AS n_items, max(score) AS best, round(sum(score::DOUBLE), 4) AS total FROM s GROUP BY 1"""


_VOCABULARY = f"SELECT DISTINCT token FROM (SELECT unnest({_tokens('t')}) AS token FROM (SELECT search_infm_params_text AS t FROM train UNION SELECT search_infm_params_text FROM benchmark_queries WHERE TRUE))"
_SEMANTIC = f"""vo AS ({_VOCABULARY}),
{_embedding("ve", "(SELECT token, [token] AS ts FROM vo)", "token", "ts")},
{_embedding("se", f"(SELECT item_id, min({_distinct('item_infm_params_text')}) AS ts FROM benchmark_items WHERE item_id IS NOT NULL GROUP BY 1)", "item_id", "ts")},
sm AS MATERIALIZED (SELECT ve.token, se.item_id FROM ve CROSS JOIN se WHERE {_dot("ve.e", "se.e")}::FLOAT >= {SEMANTIC}::FLOAT)"""

_F = "CASE WHEN NOT isnan({0}) THEN {0} END"
_RATING = _F.format("item_rating")
_MATCH = "coalesce({} = {}, false)::INT::DOUBLE"
_LOOKUP = "SELECT * FROM train WHERE item_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY interaction_id, ingested_at) = 1"
_FEATURES = "item_id, item_category_id, item_microcat_id, item_location_id, item_rating"
_PRIORITY = f"""SELECT {_FEATURES} FROM (SELECT DISTINCT item_id, item_category_id, item_microcat_id, item_location_id, {_RATING} AS item_rating, item_rating_reviews_count, item_price, item_is_phone_hidden, item_is_message_forbidden FROM benchmark_items WHERE item_id IS NOT NULL)
UNION ALL SELECT item_id, item_category_id, item_microcat_id, item_location_id, {_RATING} FROM ({_LOOKUP}) WHERE item_id NOT IN (SELECT item_id FROM benchmark_items WHERE item_id IS NOT NULL)"""


def _hist(table: str, name: str, feature: str, value: str, bins: int) -> str:
    return f"""SELECT '{feature}' AS feature, '{name}' AS population, bin, count(*) AS n, round(count(*) / (max(t) * max(w)), 6) AS density FROM (
  SELECT least(floor((v - lo) / w), {bins - 1})::BIGINT AS bin, t, w FROM (SELECT v, lo, t, (hi - lo) / {bins} AS w FROM (SELECT {value} AS v, min({value}) OVER () AS lo, max({value}) OVER () AS hi, count({value}) OVER () AS t FROM {table}) WHERE v IS NOT NULL)) GROUP BY bin"""


def _describe(c: str, kind: str) -> str:
    v = f"SELECT {kind} AS v FROM benchmark_items"
    r = lambda e: f"round(({e})::DOUBLE, 5)"
    return f"SELECT '{c}' AS column_name, count(v) AS n, {r('avg(v)')} AS mean, {r('stddev_samp(v)')} AS std, {r('min(v)')} AS min, {r('quantile_cont(v, 0.25)')} AS q25, {r('quantile_cont(v, 0.5)')} AS q50, {r('quantile_cont(v, 0.75)')} AS q75, {r('max(v)')} AS max FROM ({v})"


_ENCODED = {
    "location_match": _MATCH.format("search_location_id", "item_location_id"),
    "category_match": _MATCH.format("search_category", "item_category_id"),
    "search_is_delivery_search": "search_is_delivery_search::INT::DOUBLE",
    "item_is_phone_hidden": "item_is_phone_hidden::INT::DOUBLE",
    "item_is_message_forbidden": "item_is_message_forbidden::INT::DOUBLE",
    "item_rating": _RATING,
    "item_rating_reviews_count_log1p": "ln(1 + item_rating_reviews_count::DOUBLE)",
    "item_price_log1p": "CASE WHEN item_price > 0 THEN ln(1 + item_price::DOUBLE) END",
}


def _spearman(a: str, b: str) -> str:
    rank = lambda c: f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)"
    return f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM (SELECT {rank('x')} AS rx, {rank('y')} AS ry FROM (SELECT {_ENCODED[a]} AS x, {_ENCODED[b]} AS y FROM train) WHERE x IS NOT NULL AND y IS NOT NULL)"


_RERANKED = f"""{_LOGGED}, lr AS (SELECT *, {_ranks(list(SCORES))} FROM lg), lf AS (SELECT *, {_fuse(SCORES, (1.0,) * 5)} AS rrf_score FROM lr),
rr AS MATERIALIZED (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY round(text_coverage_score::DOUBLE * 2.0 + params_coverage_score::DOUBLE + rrf_score * 10.0, 9) DESC, rrf_score DESC, item_id) AS rank FROM lf QUALIFY rank <= {TOP_K})"""
_ANSWERS = f"""{_RERANKED}, an AS MATERIALIZED (SELECT q.query_id, coalesce(string_agg(rr.item_id, ' ' ORDER BY rr.rank), '') AS answer
  FROM (SELECT DISTINCT query_id FROM benchmark_queries WHERE query_id IS NOT NULL) q LEFT JOIN rr USING (query_id) GROUP BY 1)"""


def _example(code: str, source: str) -> str:
    return f"SELECT '{code}' AS code, count(*) AS n, array_to_string(list_sort(list_distinct(list(e)))[1:3], '|') AS examples FROM ({source}) HAVING count(*) > 0"


_VALIDATED = f"""WITH {_ANSWERS},
f0 AS (SELECT query_id, answer, CAST('0x' || substr(md5(query_id), 1, 4) AS INTEGER) % 10 AS h FROM an),
f1 AS (SELECT query_id, h, CASE WHEN h = 0 THEN answer || ' xyz' WHEN h = 1 THEN answer || ' 0000000000000000' WHEN h = 2 AND answer <> '' THEN answer || ' ' || answer ELSE answer END AS answer FROM f0 WHERE h <> 3),
fa AS MATERIALIZED (SELECT query_id, answer FROM f1 UNION ALL SELECT query_id, answer FROM f1 WHERE h = 4),
ex AS (SELECT DISTINCT query_id FROM benchmark_queries WHERE query_id IS NOT NULL),
li AS (SELECT query_id, CASE WHEN answer = '' THEN []::VARCHAR[] ELSE string_split(answer, ' ') END AS ids FROM fa),
si AS (SELECT query_id, unnest(ids) AS item_id FROM li)
SELECT 'row_count' AS code, count(*) AS n, '' AS examples FROM fa HAVING count(*) <> (SELECT count(*) FROM ex)
UNION ALL {_example("duplicate_query", "SELECT query_id AS e FROM fa GROUP BY 1 HAVING count(*) > 1")}
UNION ALL {_example("missing_query", "SELECT query_id AS e FROM ex WHERE query_id NOT IN (SELECT query_id FROM fa)")}
UNION ALL {_example("too_long", f"SELECT query_id AS e FROM li WHERE len(ids) > {TOP_K}")}
UNION ALL {_example("duplicate_items", "SELECT query_id AS e FROM li WHERE len(ids) > len(list_distinct(ids))")}
UNION ALL {_example("malformed_item", "SELECT query_id || ': ' || item_id AS e FROM si WHERE NOT regexp_matches(item_id, '^[0-9a-f]{16}$')")}
UNION ALL {_example("unknown_item", "SELECT query_id || ': ' || item_id AS e FROM si WHERE regexp_matches(item_id, '^[0-9a-f]{16}$') AND item_id NOT IN (SELECT item_id FROM benchmark_items WHERE item_id IS NOT NULL)")}"""

_VECTORS = f"SELECT q.vec_id AS query_vec, e.vec_id, {_dot('q.embedding', 'e.embedding')}::FLOAT AS similarity FROM embeddings q JOIN embeddings e ON q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id"


def _calibration() -> str:
    grid = ", ".join(f"({t}::DOUBLE)" for t in (*THRESHOLDS, 0.1, 0.2, 0.3, 0.4))
    return f"""WITH {_mean_unit("mc", "embeddings", "label", "embedding")},
p AS (SELECT {_dot("e.embedding", "mc.c")}::FLOAT AS s FROM embeddings e JOIN mc ON mc.label = e.label),
o1 AS (SELECT vec_id, embedding, row_number() OVER (ORDER BY vec_id) AS k FROM embeddings),
o2 AS (SELECT label, row_number() OVER (ORDER BY md5('0|' || vec_id), vec_id) AS k FROM embeddings),
n AS (SELECT {_dot("o1.embedding", "mc.c")}::FLOAT AS s FROM o1 JOIN o2 USING (k) JOIN mc ON mc.label = o2.label),
g AS (SELECT t, (SELECT avg((s >= t::FLOAT)::INT) FROM p) AS a, (SELECT avg((s >= t::FLOAT)::INT) FROM n) AS b FROM (VALUES {grid}) v(t))
SELECT t AS threshold, round(a, 6) AS true_positive_rate, round(b, 6) AS false_positive_rate, round(a - b, 6) AS separation FROM g"""


def _params_calibration() -> str:
    grid = ", ".join(f"({t}::DOUBLE)" for t in (*THRESHOLDS, 0.1, 0.2, 0.3, 0.4))
    return f"""WITH r0 AS (SELECT interaction_id, min({{'s': search_infm_params_text, 'p': substr(coalesce(item_infm_params_text, ''), 1, 200)}}) AS x FROM train
  WHERE coalesce(search_infm_params_text, '') <> '' AND interaction_id IS NOT NULL GROUP BY 1),
r AS MATERIALIZED (SELECT interaction_id, {_tokens("x.s")} AS ts, {_tokens("x.p")} AS it FROM r0),
{_embedding("de", "r", "interaction_id", "it")},
{_embedding("te", "(SELECT token, [token] AS ts FROM (SELECT DISTINCT unnest(ts) AS token FROM r))", "token", "ts")},
o1 AS (SELECT interaction_id, row_number() OVER (ORDER BY interaction_id) AS k FROM r),
o2 AS (SELECT interaction_id AS other_id, row_number() OVER (ORDER BY md5('0|' || interaction_id), interaction_id) AS k FROM r),
a AS (SELECT interaction_id, unnest(ts) AS token FROM r),
p AS (SELECT {_dot("te.e", "de.e")}::FLOAT AS s FROM a JOIN te USING (token) JOIN de USING (interaction_id)),
n AS (SELECT {_dot("te.e", "de.e")}::FLOAT AS s FROM a JOIN te USING (token) JOIN o1 USING (interaction_id) JOIN o2 USING (k) JOIN de ON de.interaction_id = o2.other_id),
g AS (SELECT t, (SELECT avg((s >= t::FLOAT)::INT) FROM p) AS a, (SELECT avg((s >= t::FLOAT)::INT) FROM n) AS b FROM (VALUES {grid}) v(t))
SELECT t AS threshold, round(a, 6) AS true_positive_rate, round(b, 6) AS false_positive_rate, round(a - b, 6) AS separation FROM g"""


def _lemmas() -> str:
    lemma = lambda t: f"CASE WHEN length({t}) >= 5 AND regexp_matches({t}, '[а-яё]') AND {t} IN (SELECT unnest(ts) FROM s) THEN regexp_replace({t}, '(ами|ями|ов|ев|ах|ях|ой|ый|ий|[аяоеуюыи])$', '') ELSE {t} END"
    found = "list_filter(list_transform(regexp_extract_all(coalesce(search_query, ''), '[a-zA-Zа-яА-ЯёЁ0-9]+'), lambda t: lower(t)), lambda t: length(t) >= 2)"
    return f"""WITH s AS MATERIALIZED (SELECT DISTINCT query_id, search_query, {found} AS ts FROM benchmark_queries WHERE query_id IS NOT NULL),
st AS (SELECT {lemma("w")} AS l FROM (SELECT unnest([{_STOP}]) AS w)),
x AS (SELECT query_id, search_query, unnest(ts) AS t, unnest(range(len(ts))) AS i FROM s),
y AS (SELECT query_id, search_query, i, {lemma("t")} AS l FROM x),
z AS (SELECT query_id, search_query, list(l ORDER BY i) AS ls FROM y WHERE l NOT IN (SELECT l FROM st) GROUP BY 1, 2)
SELECT s.query_id, coalesce(len(z.ls), 0)::BIGINT AS n_tokens, md5(coalesce(array_to_string(z.ls, ' '), '')) AS digest FROM s LEFT JOIN z ON z.query_id = s.query_id AND z.search_query IS NOT DISTINCT FROM s.search_query"""


def _ablation() -> str:
    f = ", ".join(f"{_fuse(SCORES, w)} AS f{n}" for n, w in enumerate(VARIANTS.values()))
    r = ", ".join(f"row_number() OVER (PARTITION BY query_id ORDER BY f{n} DESC, item_id) AS r{n}" for n in range(len(VARIANTS)))
    per = " UNION ALL ".join(f"SELECT '{v}' AS variant, rel.query_id, avg((coalesce(x.r{n} <= 50, false))::INT) AS a, avg((coalesce(x.r{n} <= 500, false))::INT) AS b FROM rel LEFT JOIN rk x USING (query_id, item_id) GROUP BY 2" for n, v in enumerate(VARIANTS))
    return f"""WITH {_EVALUATION}, {_scored(_EVAL_ITEMS, _EVAL_QUERIES)}, rs AS (SELECT *, {_ranks(list(SCORES))} FROM scored), fs AS (SELECT query_id, item_id, {f} FROM rs), rk AS MATERIALIZED (SELECT query_id, item_id, {r} FROM fs)
SELECT variant, count(*) AS n_queries, round(avg(a), 9) AS recall_50, round(avg(b), 9) AS recall_500 FROM ({per}) GROUP BY 1"""


def _prop(c: str, stat: str, expr: str, digits: int) -> str:
    a, b = f"(SELECT {expr} FROM train)", f"(SELECT {expr} FROM benchmark_items)"
    return f"SELECT '{c}' AS feature, '{stat}' AS statistic, round({a}, {digits}) AS chosen, round({b}, {digits}) AS population, round({a} - {b}, {digits}) AS delta"


def oracle_sql() -> dict[str, str]:
    generated = f"WITH {_generated(_ITEMS, _QUERIES, CONFIG.top_k)}"
    rounded = ", ".join(["query_id", "item_id", "params_coverage_score", "text_coverage_score", *(f"round({c}::DOUBLE, {n}) + 0.0::DOUBLE AS {c}" for c, n in (("text_similarity_score", 5), ("location_match_score", 5), ("location_distance_km", 2), ("microcat_match_score", 5), ("rrf_score", 9))), "rrf_rank"])
    km = _km("clat", "clon", "la", "lo")
    missing = " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(avg(({c} IS NULL{' OR isnan(item_rating)' if c == 'item_rating' else ''})::INT), 9) AS missing_rate FROM benchmark_items" for c in ("item_id", "item_category_id", "item_microcat_id", "item_location_id", "item_latitude", "item_longitude", "item_price", "item_rating", "item_rating_reviews_count", "item_is_phone_hidden", "item_is_message_forbidden"))
    comparison = f"""{_evaluated()},
ag AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY round(text_coverage_score::DOUBLE * 2.0 + params_coverage_score::DOUBLE + rrf_score * 10.0, 9) DESC, rrf_rank) AS rank FROM best),
m AS (SELECT 'rrf' AS method, rel.query_id, avg((coalesce(b.rrf_rank <= 50, false))::INT) AS r FROM rel LEFT JOIN best b USING (query_id, item_id) GROUP BY 2
  UNION ALL SELECT 'reranked', rel.query_id, avg((coalesce(a.rank <= 50, false))::INT) FROM rel LEFT JOIN ag a USING (query_id, item_id) GROUP BY 2)
SELECT method, round(avg(r), 9) AS recall FROM m GROUP BY 1"""
    features = f"""{_evaluated()},
fe AS (SELECT item_id, {_RATING} AS item_rating, item_rating_reviews_count AS rv, CASE WHEN item_price > 0 THEN item_price END AS pr, item_is_phone_hidden::INT AS hid FROM (SELECT DISTINCT item_id, item_rating, item_rating_reviews_count, item_price, item_is_phone_hidden FROM benchmark_items WHERE item_id IS NOT NULL)
  UNION ALL SELECT item_id, {_RATING}, item_rating_reviews_count, CASE WHEN item_price > 0 THEN item_price END, item_is_phone_hidden::INT FROM ({_LOOKUP}) WHERE item_id NOT IN (SELECT item_id FROM benchmark_items WHERE item_id IS NOT NULL))
SELECT b.query_id, count(*) AS n, sum((rel.item_id IS NOT NULL)::INT)::BIGINT AS n_relevant, sum(hid)::BIGINT AS n_hidden, count(item_rating) AS n_item_rating, count(rv) AS n_item_rating_reviews_count_log1p, count(pr) AS n_item_price_log1p, count(va.search_is_delivery_search) AS n_search_is_delivery_search
FROM best b LEFT JOIN fe USING (item_id) LEFT JOIN va USING (query_id) LEFT JOIN rel ON rel.query_id = b.query_id AND rel.item_id = b.item_id GROUP BY 1"""
    return {
        "tokenize_docs": f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {_tokens('text')} AS t FROM documents)",
        "tokenize_lemmas": _lemmas(),
        "embedding_cache": f"""WITH t AS (SELECT DISTINCT query_id, concat('query: ', substr(coalesce(search_query, ''), 1, 200)) AS x FROM benchmark_queries WHERE query_id IS NOT NULL),
xt AS (SELECT DISTINCT x, {_tokens("x")} AS ts FROM t), {_embedding("em", "xt", "x", "ts")}
SELECT query_id, pos::INT AS pos, round(v::DOUBLE, 6) AS v FROM (SELECT query_id, unnest(range(64)) AS pos, unnest(e) AS v FROM t JOIN em USING (x)) WHERE v <> 0""",
        "vocab_distinct": _VOCABULARY,
        "text_coverage": _sparse("search_query", _TEXT),
        "params_coverage_exact": _sparse("search_infm_params_text", "item_infm_params_text"),
        "semantic_match_matrix": f"WITH {_SEMANTIC} SELECT token, count(*) AS n_items FROM sm GROUP BY 1",
        "params_coverage_semantic": _sparse("search_infm_params_text", "item_infm_params_text", True),
        "dense_similarity_topk": f"SELECT *, row_number() OVER (PARTITION BY query_vec ORDER BY similarity DESC, vec_id) AS position FROM ({_VECTORS}) QUALIFY position <= 10",
        "location_centroids": f"SELECT location_id, clat AS centroid_lat, clon AS centroid_lon FROM ({_CENTROIDS.format(f'({_ITEMS})')})",
        "location_signal": f"""SELECT interaction_id, round((CASE WHEN search_location_id = item_location_id THEN 1.0::DOUBLE ELSE coalesce(exp(-{km} / 5.0), 0.0::DOUBLE) END)::FLOAT::DOUBLE, 5) AS score,
  round(CASE WHEN search_location_id = item_location_id THEN 0.0::DOUBLE ELSE {km} END, 4) AS distance_km
FROM (SELECT DISTINCT interaction_id, search_location_id, item_location_id, item_latitude::DOUBLE AS la, item_longitude::DOUBLE AS lo FROM train) LEFT JOIN ({_CENTROIDS.format(f'({_ITEMS})')}) ON location_id = search_location_id""",
        "microcat_centroids": f"WITH {_mean_unit('mc', 'embeddings', 'label', 'embedding')} SELECT label, n, unnest(range(64))::INT AS pos, round(unnest(c)::DOUBLE, 6) AS v FROM mc",
        "microcat_score": f"WITH {_mean_unit('mc', 'embeddings', 'label', 'embedding')} SELECT vec_id, mc.label, round({_dot('embedding', 'mc.c')}::FLOAT::DOUBLE, 5) AS score FROM embeddings CROSS JOIN mc",
        "avg_rank_ties": f"WITH {_LOGGED} SELECT query_id, item_id, {_average_rank('text_coverage_score')} AS avg_rank FROM lg",
        "rrf_fusion": _logged_fusion(list(SCORES), [1.0] * 5),
        "rrf_weighted": _logged_fusion(list(SCORES), [2.0, 1.0, 0.5, 0.0, 1.5]),
        "rrf_constant_skip": _logged_fusion(["constant", "text_similarity_score"], [1.0, 1.0], "*, 1.0::FLOAT AS constant"),
        "category_filter_branches": f"""WITH i AS (SELECT DISTINCT item_id, item_category_id FROM benchmark_items WHERE item_id IS NOT NULL), q AS (SELECT DISTINCT query_id, search_category AS c FROM benchmark_queries WHERE query_id IS NOT NULL),
b AS (SELECT query_id, c, CASE WHEN c IS NULL OR c = 0 THEN 'unspecified' WHEN c IN (SELECT item_category_id FROM i WHERE item_category_id IS NOT NULL) THEN 'confined' ELSE 'absent' END AS branch FROM q)
SELECT query_id, branch, count(*) AS n_items FROM b JOIN i ON branch <> 'confined' OR c = item_category_id GROUP BY 1, 2""",
        "candidates_topk": f"{generated} SELECT query_id, item_id, rrf_rank FROM best",
        "candidates_with_features": f"{generated} SELECT {rounded} FROM best",
        "candidates_packed": f"{generated} SELECT query_id, string_agg(item_id, ' ' ORDER BY rrf_rank) AS candidate_item_ids, count(*) AS n_candidates FROM best GROUP BY 1",
        "relevance_labels": f"SELECT query_id, {_QCOLS}, n_interactions, n_relevant FROM ({_LABELS})",
        "relevance_long": f"SELECT query_id, unnest(ids) AS item_id FROM ({_LABELS})",
        "sample_queries": f"WITH lb AS ({_LABELS}) SELECT query_id, {_QCOLS}, n_interactions FROM ({_VALIDATION})",
        "eval_corpus": f"WITH {_EVALUATION} SELECT {_ICOLS}, 'benchmark' AS origin FROM benchmark_items UNION ALL SELECT *, 'extra' FROM ({_EXTRA})",
        "train_split_reachable": f"""WITH {_EVALUATION} SELECT query_id, n_interactions FROM (SELECT * FROM lb WHERE len(ids) <= 200 AND query_id NOT IN (SELECT query_id FROM va)
  AND query_id IN (SELECT query_id FROM (SELECT query_id, unnest(ids) AS item_id FROM lb) WHERE item_id IN (SELECT item_id FROM benchmark_items)))""",
        "recall_per_query": f"{_RECALLS} SELECT k, query_id, n_relevant, round(recall, 9) AS recall FROM pq",
        "recall_at_k": f"{_RECALLS} SELECT k, round(avg(recall), 9) AS recall_at_k FROM pq GROUP BY 1",
        "relevant_item_coverage": f"""WITH {_EVALUATION} SELECT 'benchmark' AS corpus, round(avg((item_id IN (SELECT item_id FROM benchmark_items WHERE item_id IS NOT NULL))::INT), 9) AS coverage FROM rel
UNION ALL SELECT 'evaluation', round(avg((item_id IN (SELECT item_id FROM benchmark_items WHERE item_id IS NOT NULL UNION SELECT item_id FROM ({_EXTRA})))::INT), 9) FROM rel""",
        "ablation": _ablation(),
        "threshold_calibration": _calibration(),
        "params_calibration": _params_calibration(),
        "split_overlap": f"""WITH {_EVALUATION}, tr AS (SELECT query_id FROM lb WHERE n_relevant <= 200 AND query_id NOT IN (SELECT query_id FROM va)
  AND query_id IN (SELECT query_id FROM (SELECT query_id, unnest(ids) AS item_id FROM lb) WHERE item_id IN (SELECT item_id FROM benchmark_items)))
SELECT count(DISTINCT query_id) AS n_shared FROM tr WHERE query_id IN (SELECT query_id FROM va)""",
        "location_match_rate": f"SELECT round(avg({_MATCH.format('search_location_id', 'item_location_id')}), 9) AS match_rate, count(*) AS n FROM train",
        "location_match_by_group": f"SELECT item_category_id, round(avg({_MATCH.format('search_location_id', 'item_location_id')}), 9) AS match_rate, count(*) AS n FROM train WHERE item_category_id IS NOT NULL GROUP BY 1",
        "category_agreement": f"SELECT round(avg({_MATCH.format('search_category', 'item_category_id')}), 9) AS match_rate, count(*) AS n FROM train",
        "location_dispersion": "SELECT item_location_id AS location_id, round(stddev_samp(item_latitude::DOUBLE), 6) AS lat_std, round(stddev_samp(item_longitude::DOUBLE), 6) AS lon_std, count(*) AS n_items FROM benchmark_items WHERE item_location_id IS NOT NULL AND item_latitude IS NOT NULL AND item_longitude IS NOT NULL GROUP BY 1 HAVING count(*) >= 5",
        "propensity_binary": " UNION ALL ".join(_prop(c, "rate", f"avg({c}::INT)", 9) for c in ("item_is_phone_hidden", "item_is_message_forbidden")),
        "propensity_numeric": " UNION ALL ".join(_prop(c, "median", f"median(({e})::DOUBLE)", 6) for c, e in (("item_rating", _RATING), ("item_rating_reviews_count", "item_rating_reviews_count"))),
        "missing_rates": missing,
        "value_counts": "SELECT search_category AS value, count(*) AS n FROM train WHERE search_category IS NOT NULL GROUP BY 1",
        "nunique_grouped": "SELECT item_category_id, count(DISTINCT item_microcat_id) AS n_unique FROM benchmark_items WHERE item_category_id IS NOT NULL AND item_microcat_id IS NOT NULL GROUP BY 1",
        "nunique_global": " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_unique FROM benchmark_items" for c in ("item_id", "item_category_id", "item_microcat_id", "item_location_id")),
        "describe_stats": " UNION ALL ".join(_describe(c, e) for c, e in (("item_rating", _RATING), ("item_rating_reviews_count", "item_rating_reviews_count::DOUBLE"), ("item_latitude", "item_latitude::DOUBLE"))),
        "hist_density": " UNION ALL ".join(_hist(t, n, f, v, b) for t, n in (("train", "chosen"), ("benchmark_items", "corpus")) for f, v, b in (("item_rating", _RATING, 30), ("item_rating_reviews_count_log1p", "ln(1 + item_rating_reviews_count::DOUBLE)", 50), ("item_price_log1p", "CASE WHEN item_price > 0 THEN ln(1 + item_price::DOUBLE) END", 50))),
        "encode_correlation": " UNION ALL ".join(f"SELECT '{c}' AS feature, count(v) AS n, round(sum(v), 3) AS total FROM (SELECT {e} AS v FROM train)" for c, e in _ENCODED.items()),
        "spearman_matrix": " UNION ALL ".join(_spearman(a, b) for i, a in enumerate(_ENCODED) for b in list(_ENCODED)[i + 1 :]),
        "item_content": f"SELECT DISTINCT item_id, item_rating, round(ln(1 + item_rating_reviews_count::DOUBLE), 6) AS item_rating_reviews_count_log1p, round(ln(1 + pr::DOUBLE), 6) AS item_price_log1p, item_is_phone_hidden, item_is_message_forbidden FROM (SELECT item_id, {_RATING} AS item_rating, item_rating_reviews_count, CASE WHEN item_price > 0 THEN item_price END AS pr, item_is_phone_hidden::INT AS item_is_phone_hidden, item_is_message_forbidden::INT AS item_is_message_forbidden FROM benchmark_items WHERE item_id IS NOT NULL)",
        "item_features_priority": _PRIORITY,
        "train_item_lookup": f"SELECT item_id, item_category_id, item_location_id, {_RATING} AS item_rating, item_rating_reviews_count FROM ({_LOOKUP})",
        "feature_table_query": features,
        "rerank_topk": f"WITH {_RERANKED} SELECT * FROM rr",
        "rrf_baseline": "SELECT query_id, item_id, min(rrf_rank) AS rank FROM candidates WHERE query_id IS NOT NULL AND item_id IS NOT NULL AND rrf_rank <= 50 GROUP BY 1, 2",
        "baseline_comparison": comparison,
        "build_answer": f"WITH {_ANSWERS} SELECT * FROM an",
        "validate_answer": _VALIDATED,
    }
