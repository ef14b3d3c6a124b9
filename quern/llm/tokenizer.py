"""Exact byte-level BPE ids of a whole corpus.

A text is cut by the tokenizer's own pattern; each distinct piece is encoded once per task and kept in a bounded memo. A
piece is encoded by backtracking: an Aho-Corasick automaton over the vocabulary gives the longest token at every position;
tokens are laid one after the other, longest first, as long as each fits its predecessor, and on a dead end the last one
is shortened or taken back, positions known to be dead being skipped. Two tokens fit if merging their joined bytes from
scratch yields just these two; a sequence whose neighbours all fit is exactly what merging the piece yields, so the result
is exact and found in time linear in the piece. The fit of a pair is kept in a compatibility table.

Texts of any length are encoded whole. Null and empty texts get an empty list.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public tokenizers' files, and the vocabulary used.
FOLDER = os.environ.get("QUERN_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the vocabulary's pre-tokenizer pattern.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pieces, and pairs, that a task remembers; beyond that the table starts anew.
MEMO = 400_000
#: Ids that a task holds before it hands them on.
HELD = 1 << 20


class BacktrackingEncoder:
    """Encoder and decoder of one vocabulary file (base64 token and rank a line)."""

    def __init__(self, path: str, pattern: str = PATTERN):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.rank = {base64.b64decode(t): int(r) for t, r in pairs}
        self.token = [b""] * (max(self.rank.values()) + 1)
        for t, r in self.rank.items():
            self.token[r] = t
        self.split = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for t in self.rank:
            self.automaton.add_word(t.decode("latin-1"), len(t))
        self.automaton.make_automaton()
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.memo: dict[str, tuple[int, ...]] = {}
        # Offset table for decoding: all tokens' bytes in one string, and where each begins.
        self.bytes = b"".join(self.token)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in self.token])])

    def merge(self, data: bytes) -> list[bytes]:
        """The plain definition: merge the neighbours of lowest rank until none merges. For short strings only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min((self.rank.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fit(self, a: bytes, b: bytes) -> bool:
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) >= MEMO:
                self.fits.clear()
            known = self.fits[a, b] = self.merge(a + b) == [a, b]
        return known

    def encode_piece(self, data: bytes) -> tuple[int, ...]:
        rank = self.rank
        if data in rank:
            return (rank[data],)
        longest = [0] * len(data)
        for end, size in self.automaton.iter(data.decode("latin-1")):
            start = end - size + 1
            if size > longest[start]:
                longest[start] = size
        laid: list[bytes] = []
        dead = bytearray(len(data) + 1)
        at, size = 0, longest[0]
        while at < len(data):
            while size:
                t = data[at : at + size]
                if not dead[at + size] and t in rank and (not laid or self.fit(laid[-1], t)):
                    break
                size -= 1
            if size:
                laid.append(t)
                at += size
                size = longest[at] if at < len(data) else 0
            else:
                # Nothing fits here after the token before: take that one back and try a shorter one.
                dead[at] = 1
                t = laid.pop()
                at -= len(t)
                size = len(t) - 1
        return tuple(rank[t] for t in laid)

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        memo = self.memo
        for piece in self.split(text or ""):
            ids = memo.get(piece)
            if ids is None:
                ids = self.encode_piece(piece.encode("utf-8", "surrogatepass"))
                if len(piece) <= 64:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[piece] = ids
            out.extend(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        o, b = self.offsets, self.bytes
        return b"".join(b[o[i] : o[i + 1]] for i in ids).decode("utf-8", "surrogatepass")


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> BacktrackingEncoder:
    """One encoder for each worker process and vocabulary."""
    return BacktrackingEncoder(path)


def _batches(path: str, counts_only: bool):
    """Ids, or their number, of every row's text. A batch is handed on whenever it holds ``HELD`` ids, so memory follows
    the longest text, not the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode

        def ready(rows: pa.RecordBatch, ids: list[np.ndarray], sizes: list[int]) -> pa.RecordBatch:
            if counts_only:
                value = pa.array(sizes, pa.int64())
            else:
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("int32")
                value = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
            return pa.RecordBatch.from_arrays([*rows.columns[:-1], value], names=[*rows.schema.names[:-1], "value"])

        for batch in batches:
            ids, sizes, held, begin = [], [], 0, 0
            for row, text in enumerate(batch.column(batch.num_columns - 1)):
                found = encode(text.as_py())
                sizes.append(len(found))
                if not counts_only:
                    ids.append(np.array(found, "int32"))
                    held += len(found)
                if held >= HELD or row + 1 == batch.num_rows:
                    yield ready(batch.slice(begin, row + 1 - begin), ids, sizes)
                    ids, sizes, held, begin = [], [], 0, row + 1

    return run


def _apply(df: DataFrame, keys: list[str], text: str, path: str, counts_only: bool, name: str) -> DataFrame:
    kinds = dict(df.select(*keys).dtypes)
    picked = df.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.col(text).alias("t"))
    schema = ", ".join([*(f"k{i} {kinds[k]}" for i, k in enumerate(keys)), f"value {'bigint' if counts_only else 'array<int>'}"])
    done = picked.mapInArrow(_batches(path, counts_only), schema)
    return done.select(*(F.col(f"k{i}").alias(k) for i, k in enumerate(keys)), F.col("value").alias(name))


def token_ids(df: DataFrame, keys: list[str], text: str, path: str | None = None) -> DataFrame:
    """``keys`` and ``ids`` of every row's text, without special tokens; null and empty texts give an empty list."""
    return _apply(df, keys, text, path or f"{FOLDER}/{VOCABULARY}", False, "ids")


def token_counts(df: DataFrame, keys: list[str], text: str, path: str | None = None) -> DataFrame:
    """``keys`` and ``n_tokens`` of every row's text; null and empty texts have 0."""
    return _apply(df, keys, text, path or f"{FOLDER}/{VOCABULARY}", True, "n_tokens")


def decoded(df: DataFrame, keys: list[str], ids: str = "ids", path: str | None = None) -> DataFrame:
    """``keys`` and ``text`` for lists of ids; a null list gives null."""
    where = path or f"{FOLDER}/{VOCABULARY}"

    @F.pandas_udf("string")
    def decode(column):
        import pandas as pd

        own = encoder(where).decode
        return pd.Series([None if x is None else own(x) for x in column])

    return df.select(*keys, decode(F.col(ids)).alias("text"))
