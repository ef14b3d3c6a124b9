"""Records of one split that occur, exactly or almost, in another: a weighted cosine join.

Two texts match if they have the same words the same number of times, or if their words, joined by one space, differ by
at most two insertions, deletions or replacements of one character. A text becomes a vector of terms: the trigrams of its
words (``^`` and ``$`` mark a word's ends, the n-th occurrence of a trigram is a term of its own), weighted by rarity.
Reordered words leave the vector as it is, and one edit changes at most three terms. So a match's dot product is at least
the text's squared norm without its six heaviest terms; this bound is exact, and serves three prunings:

* maximum weight: terms are ordered by falling weight, and only the heaviest ones, as many as an unmatched pair could miss,
  enter the inverted lists (on both sides);
* residual norm: a pair met in the lists goes on only if its dot product so far plus the norm of what isn't listed (of the
  text whose list ends first in the common order) can still reach the bound; a few terms more than needed are listed, so
  that one common term alone doesn't. The lists are also divided by text length, which differs by two at most, and a list
  that is still long is cut into chunks on both sides;
* parity sketches: an edit changes few letters and few bigrams, so the sketches of two matches differ in few bits. They travel
  with the lists' entries, and a pair whose sketches differ more is dropped where it meets: of the pairs that meet, which grow
  with the product of the inputs, only those near a match are shuffled;
* exact dot products of the remaining pairs are held against the bound before the edit distance is computed.

Texts of few letters have no such bound. They meet by what is left of them when up to two characters are removed.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.text import same_shape_words
from quern.plans.lineage import cut_lineage
from quern.plans.skew import attach_members, salted_join

#: Document frequencies are kept by term bucket: the table has this fixed size, whatever the data.
BUCKETS = 1 << 16
EDITS = 2
#: Terms that ``EDITS`` edits can change, and terms listed besides: as many at least must be met.
LOST = 3 * EDITS
BESIDES = 3
#: Bits of the two sketches that ``EDITS`` edits can flip: a replaced letter flips two letters, and four bigrams.
LETTER_BITS, BIGRAM_BITS = 2 * EDITS, 4 * EDITS
#: A list longer than this, and than a thousandth of all entries, is cut into chunks.
HOT_LIST = 4096


_ENTRY = ["term", "id", "w", "rest", "edge", "bound", "letters", "bigrams"]


def normal_text(column: str):
    """A text's normalised words joined by one space; empty if there are none."""
    return F.array_join(same_shape_words(F.col(column)), " ")


def _terms(text: str) -> list[str]:
    """Trigrams of the padded words; a repeated trigram gets its number, so that terms form a set."""
    seen: Counter[str] = Counter()
    out = []
    for w in text.split(" "):
        w = f"^{w}$"
        for k in range(len(w) - 2):
            g = w[k : k + 3]
            seen[g] += 1
            out.append(g if seen[g] == 1 else f"{g}{seen[g]}")
    return out


def _bucket(term: str) -> int:
    return zlib.crc32(term[:3].encode("utf-8", "surrogatepass")) & (BUCKETS - 1)


def term_weights(texts: DataFrame) -> np.ndarray:
    """Squared weight of each bucket from its document frequency over all ``texts`` (text)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(BUCKETS, "int64")
        for pdf in batches:
            for t in pdf["text"]:
                n[list({_bucket(x) for x in _terms(t)})] += 1
        at = np.flatnonzero(n)
        yield pd.DataFrame({"bucket": at, "n": n[at]})

    rows = texts.mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(BUCKETS)
    df[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    top = max(1.0, df.max())
    return np.square(1.0 + np.log(top / np.maximum(df, 1.0)))


def _vector(text: str, weights: np.ndarray) -> list[tuple[float, str]]:
    """Terms with squared weights, heaviest first; ties by term, so that all texts share one order."""
    return sorted(((float(weights[_bucket(t)]), t) for t in _terms(text)), key=lambda x: (-x[0], x[1]))


def _bound(vector: list[tuple[float, str]]) -> float:
    """The least dot product with a match."""
    return math.fsum(w for w, _ in vector[LOST:]) * (1 - 1e-9)


def _removals(text: str) -> set[str]:
    return {"".join(c for i, c in enumerate(text) if i not in out) for k in range(EDITS + 1) for out in map(set, combinations(range(len(text)), k))}


def _sketches(text: str) -> tuple[int, int]:
    """Parities of the text's letters and of its padded words' bigrams, hashed to 64 bits each; the order of words is no matter."""
    letters = bigrams = 0
    for w in text.split(" "):
        for c in w:
            letters ^= 1 << (ord(c) & 63)
        w = f"^{w}$"
        for k in range(len(w) - 1):
            bigrams ^= 1 << ((ord(w[k]) * 37 + ord(w[k + 1]) * 11) & 63)
    return tuple(x - (1 << 64) if x >> 63 else x for x in (letters, bigrams))


def _lists(weights: np.ndarray, spread: int):
    """Inverted-list entries of texts: the terms by which a match must meet them. ``spread``: lengths a match may differ by."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple[str, int, float, float, float, float, int, int]] = []
            for number, text in zip(pdf["id"], pdf["text"]):
                vector, size = _vector(text, weights), len(text)
                bound = _bound(vector)
                keys: list[tuple[str, float]] = []
                rest = edge = 0.0
                if len(vector) > LOST:
                    rest = math.fsum(w for w, _ in vector)
                    for w, t in vector:
                        if rest < bound and len(keys) >= LOST + BESIDES:
                            edge = keys[-1][1]
                            break
                        keys.append((t, w))
                        rest = max(0.0, rest - w)
                    else:
                        rest = 0.0
                    keys = [(f"{n} {t}", w) for t, w in keys for n in range(size - spread, size + spread + 1)]
                else:
                    keys.append(("=" + " ".join(sorted(text.split(" "))), math.inf))
                if len(vector) <= LOST + EDITS:
                    keys += [("-" + r, math.inf) for r in _removals(text)]
                sketches = _sketches(text)
                rows += [(k, number, w, rest, edge, bound, *sketches) for k, w in keys]
            yield pd.DataFrame(rows, columns=_ENTRY)

    return run


def _dots(weights: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            known: dict[str, tuple[dict[str, float], float, float]] = {}

            def vector(text: str) -> tuple[dict[str, float], float, float]:
                if text not in known:
                    v = _vector(text, weights)
                    known[text] = {t: w for w, t in v}, math.fsum(w for w, _ in v), _bound(v)
                return known[text]

            rows = []
            for a, b in zip(pdf["text_a"], pdf["text_b"]):
                (va, na, ba), (vb, nb, bb) = vector(a), vector(b)
                dot = math.fsum(w for t, w in va.items() if t in vb)
                rows.append((a, b, max(ba, bb), dot, dot / (math.sqrt(na * nb) or 1.0)))
            yield pd.DataFrame(rows, columns=["text_a", "text_b", "least", "dot", "cosine"])

    return run


def _met(a: DataFrame, b: DataFrame) -> DataFrame:
    """``id_a, id_b, w_a, needed``: a row for each term under which two texts with near sketches meet in the lists."""
    side = lambda df, s: df.select("term", *(F.col(c).alias(f"{c}_{s}") for c in _ENTRY[1:]))
    # The list that ends first ends with the heavier term; what its text has beyond is all that may still be shared.
    first = F.when(F.col("edge_a") > F.col("edge_b"), F.col("rest_a")).when(F.col("edge_b") > F.col("edge_a"), F.col("rest_b")).otherwise(F.greatest("rest_a", "rest_b"))
    met = salted_join(side(a, "a"), side(b, "b"), "term", "id_a", "id_b", HOT_LIST)
    differ = lambda c: F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b")))
    met = met.where((differ("bigrams") <= BIGRAM_BITS) & (differ("letters") <= LETTER_BITS))
    return met.select("id_a", "id_b", "w_a", (F.greatest("bound_a", "bound_b") - first - 1e-6).alias("needed"))


def matching_texts(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs ``text_a, text_b, cosine`` of matching normal texts of ``left`` and ``right`` (column text), each text once.

    Empty and null texts never match. Both inputs may repeat texts; empty inputs give no pairs.
    """
    once = lambda df: cut_lineage(df.select("text").where("text <> ''").distinct().select(F.monotonically_increasing_id().alias("id"), "text"))
    left, right = once(left), once(right)
    weights = term_weights(left.select("text").unionByName(right.select("text")))
    schema = "term string, id long, w double, rest double, edge double, bound double, letters long, bigrams long"
    a = cut_lineage(left.mapInPandas(_lists(weights, EDITS), schema))
    b = cut_lineage(right.mapInPandas(_lists(weights, 0), schema))
    met = _met(a, b)
    # What is needed is the same in all rows of a pair. Only numbers are shuffled; texts join the pairs that are left.
    met = met.groupBy("id_a", "id_b").agg(F.sum("w_a").alias("dot"), F.max("needed").alias("needed")).where("dot >= needed")
    for s, df in (("a", left), ("b", right)):
        met = met.join(df.select(F.col("id").alias(f"id_{s}"), F.col("text").alias(f"text_{s}")), f"id_{s}")
    exact = met.select("text_a", "text_b").mapInPandas(_dots(weights), "text_a string, text_b string, least double, dot double, cosine double")
    exact = exact.where(F.col("dot") >= F.col("least"))
    bag = lambda c: F.array_join(F.array_sort(F.split(c, " ")), " ")
    return exact.where((F.levenshtein("text_a", "text_b", EDITS) >= 0) | (bag("text_a") == bag("text_b"))).select("text_a", "text_b", "cosine")


def _sides(evaluation: DataFrame, train: DataFrame) -> tuple[DataFrame, DataFrame]:
    queries = evaluation.select("query_id", "eval_split", "source", F.explode(F.array_distinct(F.array(normal_text("search_query"), normal_text("search_infm_params_text")))).alias("text"))
    return queries.where("text <> ''"), train.select("interaction_id", normal_text("search_query").alias("text")).where("text <> ''")


def cross_split_pairs(evaluation: DataFrame, train: DataFrame) -> DataFrame:
    """Distinct ``query_id, interaction_id`` where the interaction's search_query matches the query's search_query or params.

    Rows with a null id, or without words, don't match. Texts are joined once each; ids are attached afterwards, hot
    texts in chunks.
    """
    queries, logged = _sides(evaluation, train)
    pairs = cut_lineage(matching_texts(queries, logged).select("text_a", "text_b"))
    asked = cut_lineage(queries.where("query_id IS NOT NULL").select(F.col("text").alias("text_a"), F.col("query_id").alias("id")).distinct())
    known = cut_lineage(logged.where("interaction_id IS NOT NULL").select(F.col("text").alias("text_b"), F.col("interaction_id").alias("id")).distinct())
    pairs = attach_members(pairs, asked, "text_a", "query_id").select("query_id", "text_b").distinct()
    return attach_members(pairs, known, "text_b", "interaction_id").select("query_id", "interaction_id").distinct()


def overlap_report(evaluation: DataFrame, train: DataFrame) -> DataFrame:
    """Per eval_split and source (null is one of its own): ``n_queries``, ``n_overlapping`` of them, ``n_exact`` with the same
    words, and ``n_interactions`` repeated, counted once per query. Rows of one query repeated as a whole count once."""
    queries, logged = _sides(evaluation, train)
    pairs = matching_texts(queries, logged)
    bag = lambda c: F.array_join(F.array_sort(F.split(c, " ")), " ")
    counts = logged.where("interaction_id IS NOT NULL").distinct().groupBy(F.col("text").alias("text_b")).agg(F.count(F.lit(1)).alias("n"))
    asked = queries.where("query_id IS NOT NULL").distinct()
    hits = asked.join(pairs.withColumnRenamed("text_a", "text"), "text").select("query_id", "eval_split", "source", "text_b", (bag("text") == bag("text_b")).cast("int").alias("same"))
    hits = hits.groupBy("query_id", "eval_split", "source", "text_b").agg(F.max("same").alias("same")).join(counts, "text_b")
    hits = hits.groupBy("query_id", "eval_split", "source").agg(F.max("same").alias("same"), F.sum("n").alias("n"))
    every = evaluation.where("query_id IS NOT NULL").select("query_id", "eval_split", "source").distinct().groupBy("eval_split", "source").agg(F.count(F.lit(1)).alias("n_queries"))
    found = hits.groupBy("eval_split", "source").agg(F.count(F.lit(1)).alias("n_overlapping"), F.sum("same").cast("long").alias("n_exact"), F.sum("n").alias("n_interactions"))
    e, f = every.alias("e"), found.alias("f")
    joined = e.join(f, F.col("e.eval_split").eqNullSafe(F.col("f.eval_split")) & F.col("e.source").eqNullSafe(F.col("f.source")), "left")
    zero = lambda c: F.coalesce(F.col(f"f.{c}"), F.lit(0).cast("long")).alias(c)
    return joined.select("e.eval_split", "e.source", "e.n_queries", zero("n_overlapping"), zero("n_exact"), zero("n_interactions"))
