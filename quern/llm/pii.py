"""Personal information inside free text: a linear-chain conditional random field over word-shape features.

Every token has attributes (its word, shape, length, beginning and ends, whether it has the ending of a surname or
patronymic); the field scores them at seven offsets around each position, plus how many digits the token's run of figures has. As attributes belong to single tokens, a distinct token's scores are computed once for each batch and looked
up; the Viterbi decoder then runs over whole batches of texts in numpy. Weights are trained on the small labelled table
of ``pii_labels``, once for each driver process, by stochastic gradient on the exact likelihood.

A decoded span is kept if it is what its kind is by definition: a phone or document number has enough figures, an address a
house number, an email address its two parts, a name two parts.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.pii_labels import DIGITS, KINDS, LABELS, ROWS, labelled_rows

OFFSETS = (-3, -2, -1, 0, 1, 2, 3)
HASHED = 1 << 14
EPOCHS = 6
#: Positions, padding included, that are decoded at a time.
WIDEST = 60_000
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "person_name": "[PERSON_NAME]"}

_TOKEN = re.compile(r"[^\W\d_]+|\d+|\n|[^\w\s]|_")
_JOINED = {"-", ".", "(", ")", "+", "/"}
_ZERO = {"о", "o"}
_MIDDLE = re.compile(r"(?:вич|вна|ична|vich|vna)$")
_LAST = re.compile(r"(?:ов|ова|ев|ева|ин|ина|ын|ына|ский|ская|цкий|цкая|енко|швили|дзе|чук|ян|ov|ova|ev|eva|in|ina|skiy|skaya|enko|shvili|dze|chuk|yan)$")
_RUNS = 64


def tokens_of(text: str) -> list[tuple[int, int, str]]:
    return [(*m.span(), m[0]) for m in _TOKEN.finditer(text)]


@functools.lru_cache(maxsize=200_000)
def _attributes(token: str) -> tuple[int, ...]:
    """Hashed attributes of one token."""
    low = token.lower().replace("ё", "е")
    if token.isdigit():
        names = [f"n{min(len(token), 16)}", "n", f"n{len(token)}{token[0]}" if len(token) in (1, 10, 11) else "n-"]
    elif not token[0].isalpha():
        names = [f"p{token}"]
    else:
        case = "U" if token.isupper() else "T" if token[0].isupper() else "l"
        script = "r" if "а" <= low[0] <= "я" else "e"
        size = min(len(token), 9)
        names = [f"w{low}", f"f{low[-4:]}", f"s{case}{script}", f"s{case}{script}{'1' if size == 1 else '2' if size < 4 else '3'}", f"e{low[-3:]}", f"e{low[-2:]}", f"b{low[:3]}"]
        if _MIDDLE.search(low) and size > 5:
            names += ["middle", f"middle{case}"]
        elif _LAST.search(low) and size > 3:
            names += ["last", f"last{case}{script}"]
        if low in DIGITS:
            names.append("digitword")
    return tuple(zlib.crc32(x.encode()) % HASHED for x in names)


class _Figures(dict):
    """Whether a token is a figure or a figure's word, by token."""

    def __missing__(self, token: str) -> bool:
        if len(self) > 1 << 18:
            self.clear()
        self[token] = known = token.isdigit() or token.lower() in DIGITS
        return known


_FIGURE = _Figures()


def _run_classes(found: list[tuple[int, int, str]]) -> list[int]:
    """For each token the class of its run of figures: 0 outside, else by the number of figures and the beginning."""
    out = [0] * len(found)
    figures, after = _FIGURE, 0
    for k in [k for k, x in enumerate(found) if figures[x[2]] or x[2] == "+"]:
        if k < after:
            continue
        begin, end, t = found[k]
        if t == "+" and not (k + 1 < len(found) and found[k + 1][2].isdigit()):
            continue
        count, last, at, where = 0, k, k, end
        while at < len(found):
            b, e, x = found[at]
            gap = b - where if at > k else 0
            low = x.lower()
            if x.isdigit():
                count += len(x)
                last = at
            elif low in DIGITS or (low in _ZERO and gap == 0):
                count += 1
                last = at
            elif set(low) <= _ZERO and gap == 0:
                count += len(low)
                last = at
            elif x not in _JOINED or (x in ".-/" and text_gap(found, at)):
                break
            if gap > 1:
                break
            where = e
            at += 1
        first = 1 if t == "+" else 2 if t[0] == "8" or t.lower() == DIGITS[8] else 3 if t[0] == "7" else 0
        cls = 1 + min(count, 15) * 4 - 4 + first
        for j in range(k, last + 1):
            out[j] = min(_RUNS - 1, max(1, cls))
        after = last + 1
    return out


def text_gap(found: list[tuple[int, int, str]], at: int) -> bool:
    """Whether white space or the text's end follows the mark at ``at``."""
    return at + 1 >= len(found) or found[at + 1][0] > found[at][1]


def _scattered(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``rows`` by place."""
    return np.stack([np.bincount(at, rows[:, k], n) for k in range(rows.shape[1])], 1).astype("float32")


class Tagger:
    """Weights, likelihood gradient and Viterbi decoder."""

    def __init__(self):
        n = len(LABELS)
        self.w = np.zeros((len(OFFSETS), HASHED, n), "float32")
        self.run = np.zeros((3, _RUNS, n), "float32")
        self.bias = np.zeros(n, "float32")
        self.step = np.zeros((n, n), "float32")
        # I of a kind only follows B or I of that kind, and begins no text.
        self.bar = np.zeros((n, n), "float32")
        for j, to in enumerate(LABELS):
            if to[0] == "I":
                self.bar[[i for i, frm in enumerate(LABELS) if frm[1:] != to[1:] or frm == "O"], j] = -1e4
        self.first = np.array([-1e4 if x[0] == "I" else 0.0 for x in LABELS], "float32")

    @staticmethod
    def _layout(texts: list[list[tuple[int, int, str]]]):
        kinds: dict[str, int] = {}
        ids = [np.array([kinds.setdefault(t, len(kinds)) for _, _, t in x], "int64") for x in texts]
        runs = [np.array(_run_classes(x), "int64") for x in texts]
        return list(kinds), ids, runs

    def _scores(self, kinds: list[str], ids: list[np.ndarray], runs: list[np.ndarray]) -> np.ndarray:
        """Scores (text, position, label), padded."""
        n, width, pad = len(ids), max(len(x) for x in ids), max(-OFFSETS[0], OFFSETS[-1])
        attributes = [_attributes(t) for t in kinds]
        flat = np.fromiter((a for x in attributes for a in x), "int64")
        starts = np.concatenate([[0], np.cumsum([len(x) for x in attributes])[:-1]])
        grid = np.full((n, width + 2 * pad), len(kinds), "int64")
        run = np.zeros((n, width + 2), "int64")
        for k, (x, r) in enumerate(zip(ids, runs)):
            grid[k, pad : pad + len(x)] = x
            run[k, 1 : 1 + len(r)] = r
        out = np.broadcast_to(self.bias, (n, width, len(LABELS))).copy()
        edge = np.zeros((1, len(LABELS)), "float32")
        for o, off in enumerate(OFFSETS):
            table = np.concatenate([np.add.reduceat(self.w[o][flat], starts), edge])
            out += table[grid[:, pad + off : pad + off + width]]
        for o in range(3):
            out += self.run[o][run[:, o : o + width]]
        return out

    def decode(self, texts: list[list[tuple[int, int, str]]]) -> list[np.ndarray]:
        """The best labels of every text (all non-empty), batch-wise over positions."""
        kinds, ids, runs = self._layout(texts)
        scores = self._scores(kinds, ids, runs)
        n, width, labels = scores.shape
        trans = self.step + self.bar
        size = np.array([len(x) for x in ids])
        back = np.zeros((width, n, labels), "int8")
        at = scores[:, 0] + self.first
        final = at.copy()
        for t in range(1, width):
            cand = at[:, :, None] + trans
            back[t] = cand.argmax(1)
            at = np.take_along_axis(cand, back[t][:, None, :].astype("int64"), 1)[:, 0] + scores[:, t]
            live = size > t
            final[live] = at[live]
        best = np.zeros((n, width), "int64")
        label = final.argmax(1)
        rows = np.arange(n)
        for t in range(width - 1, -1, -1):
            here = size > t
            best[here, t] = label[here]
            label = np.where(here & (t > 0), back[t][rows, label], label)
        return [best[k, : size[k]] for k in range(n)]

    def train(self, table: list[tuple[str, list[tuple[int, int, str]]]], epochs: int = EPOCHS, batch: int = 250, rate: float = 0.25, seed: int = 1) -> Tagger:
        rng = np.random.default_rng(seed)
        texts, gold = [], []
        for text, spans in table:
            found = tokens_of(text)
            if not found:
                continue
            y = np.zeros(len(found), "int64")
            for b, e, kind in spans:
                inside = [k for k, (s, _, _) in enumerate(found) if b <= s < e]
                y[inside] = LABELS.index(f"I-{kind}")
                y[inside[:1]] = LABELS.index(f"B-{kind}")
            texts.append(found)
            gold.append(y)
        sums = {k: np.full_like(getattr(self, k), 1e-6) for k in ("w", "run", "bias", "step")}
        labels = len(LABELS)
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            # Texts of like length share a batch.
            order = order[np.argsort([len(texts[k]) // 4 for k in order], kind="stable")]
            groups = [order[i : i + batch] for i in range(0, len(order), batch)]
            for g in [groups[i] for i in rng.permutation(len(groups))]:
                kinds, ids, runs = self._layout([texts[k] for k in g])
                scores = self._scores(kinds, ids, runs)
                n, width, _ = scores.shape
                size = np.array([len(x) for x in ids])
                mask = np.arange(width)[None, :] < size[:, None]
                trans = self.step + self.bar
                et = np.exp(trans)
                alpha = np.zeros((n, width, labels), "float32")
                norm = np.zeros((n, width), "float32")
                x = np.exp(scores - scores.max(2, keepdims=True))
                a = x[:, 0] * np.exp(self.first)
                for t in range(width):
                    if t:
                        a = (a @ et) * x[:, t]
                    s = a.sum(1, keepdims=True) + 1e-30
                    a = a / s
                    alpha[:, t] = a
                    norm[:, t] = s[:, 0]
                beta = np.ones((n, labels), "float32")
                expected = np.zeros_like(alpha)
                pair = np.zeros((labels, labels), "float32")
                for t in range(width - 1, -1, -1):
                    if t + 1 < width:
                        b = beta * x[:, t + 1] / norm[:, t + 1 : t + 2]
                        step = mask[:, t + 1]
                        pair += np.einsum("ni,nj->ij", alpha[:, t] * step[:, None], b) * et
                        beta = np.where(step[:, None], b @ et.T, 1.0)
                    expected[:, t] = alpha[:, t] * beta
                expected /= expected.sum(2, keepdims=True) + 1e-30
                truth = np.zeros((n, width, labels), "float32")
                seen = np.zeros_like(pair)
                for k, idx in enumerate(g):
                    truth[k, np.arange(size[k]), gold[idx]] = 1
                    np.add.at(seen, (gold[idx][:-1], gold[idx][1:]), 1)
                diff = (expected - truth) * mask[:, :, None] / len(g)
                attributes = [_attributes(t) for t in kinds]
                flat = np.fromiter((f for y in attributes for f in y), "int64")
                owner = np.repeat(np.arange(len(kinds)), [len(y) for y in attributes])
                used, where = np.unique(flat, return_inverse=True)
                grad = np.zeros((len(OFFSETS), len(used), labels), "float32")
                token = np.full((n, width), len(kinds), "int64")
                rungrid = np.zeros((n, width + 2), "int64")
                for k, (y, r) in enumerate(zip(ids, runs)):
                    token[k, : len(y)] = y
                    rungrid[k, 1 : 1 + len(r)] = r
                for o, off in enumerate(OFFSETS):
                    lo, hi = max(0, -off), min(width, width - off)
                    if hi <= lo:
                        continue
                    per = _scattered(token[:, lo + off : hi + off].ravel(), diff[:, lo:hi].reshape(-1, labels), len(kinds) + 1)
                    grad[o] = _scattered(where, per[owner], len(used))
                rungrad = np.stack([_scattered(rungrid[:, o : o + width].ravel(), diff.reshape(-1, labels), _RUNS) for o in range(3)])
                # Of the attributes' weights only those in the batch change.
                for name, at, d in (("w", (slice(None), used), grad), ("run", ..., rungrad), ("bias", ..., diff.sum((0, 1))), ("step", ..., (pair - seen) / len(g))):
                    value, total = getattr(self, name), sums[name]
                    d = d + 1e-5 * value[at]
                    total[at] += d * d
                    value[at] -= rate * d / np.sqrt(total[at])
        return self


@functools.lru_cache(maxsize=1)
def trained(rows: int = ROWS) -> Tagger:
    """The tagger, trained on ``rows`` labelled rows; once for each process."""
    return Tagger().train(labelled_rows(rows))


def _possible(kind: str, part: str) -> bool:
    """Whether a decoded span can be what it is called."""
    figures = sum(c.isdigit() for c in part)
    low = part.lower()
    if kind == "phone":
        spelled = sum(w in DIGITS for w in re.findall(r"[^\W\d_]+", low)) + len(re.findall(r"(?<=[\d\-.])[оo]+|[оo](?=\d)", low))
        return 5 <= figures + spelled <= 14
    if kind == "id_number":
        return figures >= 8
    if kind == "address":
        return figures >= 1 and len(re.findall(r"[^\W\d_]{2,}", low)) >= 1
    if kind == "email":
        return bool(re.search(r"@|собак|\bat\b", low)) and bool(re.search(r"\.|точка|\bdot\b", low))
    return len(re.findall(r"[^\W\d_]+", low)) >= 2 and figures == 0


def _trimmed(text: str, b: int, e: int) -> tuple[int, int]:
    """A span without the punctuation around it; the dot of initials stays."""
    while b < e and not (text[b].isalnum() or text[b] in "+("):
        b += 1
    while e > b and not text[e - 1].isalnum() and not (text[e - 1] == "." and e - b > 2 and text[e - 2].isalpha() and not text[e - 3].isalpha()):
        e -= 1
    return b, e


def find_spans(tagger: Tagger, texts: list[str | None], size: int = 256) -> list[list[tuple[int, int, str]]]:
    """(begin, end, kind) spans of every text; nothing for null and empty ones. Texts of like length are decoded together."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    found = {k: f for k, t in enumerate(texts) if t and (f := tokens_of(t))}
    order = sorted(found, key=lambda k: len(found[k]))
    i = 0
    while i < len(order):
        # Fewer texts at a time where they are long.
        part = order[i : i + max(1, min(size, WIDEST // len(found[order[min(i + size, len(order)) - 1]])))]
        i += len(part)
        for k, labels in zip(part, tagger.decode([found[k] for k in part])):
            begin = None
            marks = [*labels.tolist(), 0]
            for at, y in enumerate(marks):
                if begin is not None and not (y and LABELS[y][0] == "I"):
                    kind = LABELS[marks[begin]][2:]
                    b, e = _trimmed(texts[k], found[k][begin][0], found[k][at - 1][1])
                    if _possible(kind, texts[k][b:e]):
                        out[k].append((b, e, kind))
                    begin = None
                if y and LABELS[y][0] == "B":
                    begin = at
    return out


def masked(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """The text with every span replaced by its typed placeholder, all else unchanged."""
    if text is None:
        return None
    parts, last = [], 0
    for b, e, kind in spans:
        parts += [text[last:b], PLACEHOLDERS[kind]]
        last = e
    return "".join([*parts, text[last:]])


def _distinct_texts(df: DataFrame, fields: list[str], id_col: str) -> DataFrame:
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in fields)))
    return df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), pairs.alias("p")).select("id", "p.field_name", "p.text").where("text <> ''").distinct()


def personal_data(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """Distinct ``<id>, field_name, pii_type`` found in the text ``fields``; null and empty texts have none. Whole texts are read."""
    tagger = trained()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            spans = find_spans(tagger, pdf["text"].tolist())
            kinds = [sorted({k for _, _, k in s}) for s in spans]
            at = np.repeat(np.arange(len(pdf)), [len(x) for x in kinds])
            yield pd.DataFrame({"id": pdf["id"].to_numpy()[at], "field_name": pdf["field_name"].to_numpy()[at], "pii_type": [k for x in kinds for k in x]})

    rows = _distinct_texts(df, fields, id_col)
    found = rows.mapInPandas(run, f"id {dict(df.dtypes)[id_col]}, field_name string, pii_type string").distinct()
    return found.select(F.col("id").alias(id_col), "field_name", "pii_type")


def redact(df: DataFrame, fields: list[str]) -> DataFrame:
    """``df`` with personal data in ``fields`` replaced by typed placeholders; nulls, other columns and all other text stay."""
    tagger = trained()

    @F.pandas_udf("string")
    def replace(column: pd.Series) -> pd.Series:
        texts = [None if x is None else str(x) for x in column]
        return pd.Series([masked(t, s) for t, s in zip(texts, find_spans(tagger, texts))], dtype="object")

    return df.withColumns({f: replace(F.col(f)) for f in fields})
