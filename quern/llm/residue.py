"""Template residue, filler, error pages and script notices instead of real content.

Labelled exemplars (``residue_labels``) are kept in an inverted index under their rarest term. A document's terms retrieve the
exemplars whose rarest term it has; around each hit a passage window, inside one sentence, is held against the exemplar.
TF-IDF containment is the share of the exemplar's weight that the window covers, where weights come from the document
frequencies of all documents; a high share marks the document. A message (not a slot or value) counts as spoken about, and
doesn't mark, where a term of what sellers do, teach or explain stands in or right beside its window.

Documents are tokenised once: one pass gives both the exemplars' document frequencies and, for each window that could cover
enough under any weights, the set of terms covered. Only these few rows are weighed afterwards.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.residue_labels import ABOUT, ABOUT_SLACK, exemplars, residue_terms
from quern.plans.lineage import cut_lineage

#: Least share of an exemplar's weight that a window must cover, and terms up to which an exemplar must be covered whole.
COVERED, WHOLE = 0.86, 4
#: Terms that say little in any text; an exemplar is never retrieved by one of them alone if it has another.
_COMMON = {"PAGE", "SERVER", "TEXT", "FUTURE", "HERE", "TEMP", "UNIT", "REQUIRES", "MANY", "LATER", "HUMAN", "ERROR", "NUMBER", "YOUR", "ACCESS", "BROWSER", "в", "на", "под", "for", "для", "is", "of", "to", "or", "by", "you", "are", "я", "или", "и", "какой", "то"}


class ResidueIndex:
    """Inverted index of the exemplars."""

    def __init__(self):
        self.entries = exemplars()
        self.terms = sorted({t for _, _, e in self.entries for t in e})
        self.index: dict[str, list[int]] = {}
        for k, (_, _, terms) in enumerate(self.entries):
            if len(terms) > WHOLE:
                # A window may lack any one term of a long exemplar.
                for t in set(terms):
                    self.index.setdefault(t, []).append(k)
            else:
                self.index.setdefault(min(terms, key=lambda t: (t in _COMMON, -len(t), t)), []).append(k)
        self.counts = [Counter(terms) for _, _, terms in self.entries]

    def windows(self, terms: list[str]) -> dict[int, set[int]]:
        """Per exemplar the sets of its terms, as bits, that some window covers; only sets that can suffice, and only where the
        window isn't spoken about."""
        at = [k for k, t in enumerate(terms) if t in self.index]
        if not at:
            return {}
        ends = [k for k, t in enumerate(terms) if t == "¶"]
        found: dict[int, set[int]] = {}
        e = 0
        for k in at:
            while e < len(ends) and ends[e] < k:
                e += 1
            low, high = ends[e - 1] + 1 if e else 0, ends[e] if e < len(ends) else len(terms)
            for n in self.index[terms[k]]:
                speakable, slack, own = self.entries[n]
                size, counts = len(own) + slack, self.counts[n]
                least = len(own) - (len(own) > WHOLE)
                for start in range(max(low, k - size + 1), k + 1):
                    window = terms[start : min(high, start + size)]
                    if window[0] not in counts or len(window) < least:
                        continue
                    have = {t: min(c, window.count(t)) for t, c in counts.items()}
                    if sum(have.values()) < least:
                        continue
                    if speakable:
                        last = start + max(i for i, t in enumerate(window) if t in counts)
                        if ABOUT in terms[max(low, start - ABOUT_SLACK) : min(high, last + 1 + ABOUT_SLACK)]:
                            continue
                    mask, seen = 0, Counter()
                    for bit, t in enumerate(own):
                        seen[t] += 1
                        mask |= (seen[t] <= have[t]) << bit
                    found.setdefault(n, set()).add(mask)
        return found

    def sufficient(self, df: dict[str, int], n_docs: int) -> list[tuple[int, int]]:
        """The (exemplar, set of terms) that cover enough, by the weights of ``df``: a table that doesn't grow with the data."""
        weight = {t: math.log((n_docs + 2) / (df.get(t, 0) + 1)) for t in self.terms}
        out = []
        for n, (_, _, own) in enumerate(self.entries):
            whole = sum(weight[t] for t in own) or 1.0
            full = (1 << len(own)) - 1
            masks = [full] if len(own) <= WHOLE else [full, *(full & ~(1 << b) for b in range(len(own)))]
            out += [(n, m) for m in masks if m == full or sum(weight[t] for b, t in enumerate(own) if m >> b & 1) >= COVERED * whole]
        return out


def _scanned(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """One pass over the texts: ``id, entry, mask`` of windows, and rows with a negative entry that count documents by term."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ResidueIndex()
        known = frozenset(index.terms)
        df: Counter[str] = Counter()
        n_docs, id_type = 0, None
        for batch in batches:
            id_type = batch.column(0).type
            at, entries, masks = [], [], []
            for row, t in enumerate(batch.column(1).to_pylist()):
                n_docs += 1
                terms = residue_terms(t)
                df.update(known.intersection(terms))
                for n, sets in index.windows(terms).items():
                    for m in sets:
                        at.append(row)
                        entries.append(n)
                        masks.append(m)
            if at:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(entries, pa.int32()), pa.array(masks, pa.int64())], names=["id", "entry", "n"])
        if id_type is not None:
            counts = [n_docs, *(df[t] for t in index.terms)]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(counts), id_type), pa.array(range(-1, -1 - len(counts), -1), pa.int32()), pa.array(counts, pa.int64())], names=["id", "entry", "n"])

    return docs.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("t")).mapInArrow(run, f"id {kind}, entry int, n long")


def residue_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Distinct ids of the documents whose text is or holds residue; a null id is one of its own.

    Null, empty and blank texts, and leftover markup alone, aren't residue. Whole texts are read; an empty table gives
    no rows. Extra columns are ignored.
    """
    index = ResidueIndex()
    scanned = cut_lineage(_scanned(docs, id_col, text))
    counts = {r["entry"]: r["n"] for r in scanned.where("entry < 0").groupBy("entry").agg(F.sum("n").alias("n")).collect()}
    df = {t: counts.get(-2 - k, 0) for k, t in enumerate(index.terms)}
    enough = docs.sparkSession.createDataFrame(index.sufficient(df, counts.get(-1, 0)), "entry int, n long")
    return scanned.where("entry >= 0").join(F.broadcast(enough), ["entry", "n"], "left_semi").select(F.col("id").alias(id_col)).distinct()


def clean_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents that hold residue; rows with a null id stay."""
    return docs.join(residue_documents(docs, id_col, text), id_col, "left_anti")
