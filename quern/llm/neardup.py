"""Near-duplicate records by pigeonring filtering.

Records are sets of words. Their words, in the order of their hashes, form a ring, and two records are compared on the ring
of their united words: every word there is a segment that differs if only one of the two has it. A Jaccard similarity of at
least 7/10 means that at most 3/10 of the ring's segments differ. Then the pigeonring principle holds: from some segment
on, every chain of l consecutive segments has at most l * 3/10 differences. In other words, the chain begins with three
common words, and the next difference of either record is allowed only after c common words where c * 3/7 exceeds the
differences so far. Nothing is lost, whatever the records' sizes.

Each record therefore lists, from each of its words on, the common words with which such a chain may begin: it skips as
many of its own words as the proportional budget allows at each place. Records meet where they list the same chain. A chain
is followed until its words are rare enough together that few records are expected to share it. This depends only on the
chain's words and on the words' frequencies over all records, so both records of a pair decide alike, and as the collection
grows, chains grow with its logarithm instead of lists with its size.

Of the pairs that meet, a parity sketch of 128 bits, whose distance is never above the true one, discards almost all
others; the full Hamming check decides the rest. Records with the same words form one class, and all runs over classes.

Chains move in columns: each batch of classes sends one row of packed numbers to each part of the key range, so the cost of
a shuffled chain is a few bytes. Parts are sized by the number of chains; a key range that holds far more than its share is
divided into chunks of classes, and each two chunks meet in a part of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.text import words
from quern.llm.components import connected_components
from quern.plans.lineage import cut_lineage, discard
from quern.plans.skew import attach_members

#: Similarity as a fraction, and the least number of distinct words.
SIMILAR = (7, 10)
LEAST_WORDS = 25
#: Records expected to share a chain by chance: about as many as cost less to compare than a longer chain costs.
SHARED = 256
#: Word and chain frequencies are kept by hash bucket: tables of fixed size.
BUCKETS = 1 << 16
#: Chains that one part takes, and words whose chains a task lists at a time.
PART, SLICE = 1_000_000, 1 << 17


def word_sets(df: DataFrame, id_col: str, texts: list[str], least: int = LEAST_WORDS) -> DataFrame:
    """``id, words, d0, d1``: sorted hashes (64 bits) of the distinct words of all ``texts`` (null is empty) and a digest of
    128 bits of them, for rows with an id and enough words."""
    whole = F.concat_ws("\n", *(F.col(c) for c in texts))
    hashed = F.sort_array(F.array_distinct(F.transform(words(whole), lambda w: F.xxhash64(w))))
    sets = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), hashed.alias("words")).where(F.size("words") >= least)
    return sets.select("id", "words", F.xxhash64("words").alias("d0"), F.xxhash64(F.lit(1), "words").alias("d1"))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _bucket(mixed: np.ndarray) -> np.ndarray:
    return ((mixed >> np.uint64(44)) & np.uint64(BUCKETS - 1)).astype("int64")


def _totals(df: DataFrame, count) -> np.ndarray:
    """Sums of the bucket counts that ``count`` gives for each task's batches: a table of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS, "int64")
        for batch in batches:
            n += count(batch)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["bucket", "n"])

    rows = df.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS, "int64")
    out[rows["bucket"].to_numpy(dtype="int64")] = rows["n"].to_numpy()
    return out


def word_weights(classes: DataFrame) -> tuple[np.ndarray, int]:
    """Thousandths of -ln(share of classes) of every word bucket, over all classes, and the chain weight that suffices."""
    df = _totals(classes.select("words"), lambda b: np.bincount(_bucket(_mix(_hashes(b.column(0))[0])), minlength=BUCKETS))
    total = max(1, classes.count())
    weights = np.round(1000 * np.log(total / np.clip(df, 1, total))).astype("int64")
    return weights, int(1000 * math.log(max(1.0, total / SHARED)))


def _hashes(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All words of a column of lists, and the lists' sizes."""
    return lists.flatten().to_numpy().view("uint64"), np.diff(lists.offsets.to_numpy())


def _chains(word: np.ndarray, size: np.ndarray, weights: np.ndarray, enough: int, similar: tuple[int, int], least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, key) of the chains of all rows; ``word`` holds the rows' mixed words in ring order."""
    part, whole = similar
    # Any two similar records have so many words in common, so no chain needs to be longer.
    longest = max(1, -(-part * least // whole))
    begin = np.cumsum(size) - size
    weight = weights[_bucket(word)]
    row = np.repeat(np.arange(len(size)), size)
    first = np.arange(len(word)) - begin[row]
    key, mass, used, gone = _mix(word), weight.copy(), np.ones(len(word), "int64"), np.zeros(len(word), "int64")
    for common in range(1, longest + 1):
        done = (mass >= enough) if common < longest else np.ones(len(mass), bool)
        yield row[done], key[done]
        rest = ~done
        row, first, key, mass, used, gone = row[rest], first[rest], key[rest], mass[rest], used[rest], gone[rest]
        most = common * (whole - part) // part
        live, skip, found = np.arange(len(row)), 0, []
        while len(live := live[(gone[live] + skip <= most) & (used[live] + skip < size[row[live]])]):
            at = begin[row[live]] + (first[live] + used[live] + skip) % size[row[live]]
            found.append((row[live], first[live], _mix(key[live] * np.uint64(3) + word[at]), mass[live] + weight[at], used[live] + skip + 1, gone[live] + skip))
            skip += 1
        if not found:
            return
        row, first, key, mass, used, gone = (np.concatenate(x) for x in zip(*found))


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(cls, mixed words, sizes) of parts of a batch (cls, words) with a bounded number of words, if rows allow."""
    cls = batch.column(0).to_numpy()
    h, size = _hashes(batch.column(1))
    word, ends = _mix(h), np.cumsum(size)
    a = 0
    while a < len(size):
        before = ends[a] - size[a]
        b = max(a + 1, int(np.searchsorted(ends, before + SLICE, "right")))
        yield cls[a:b], word[before : ends[b - 1]], size[a:b]
        a = b


def _sketches(word: np.ndarray, size: np.ndarray) -> np.ndarray:
    row = np.repeat(np.arange(len(size)), size)
    out = np.zeros((2, len(size)), "uint64")
    bit = np.left_shift(np.uint64(1), (word >> np.uint64(3)) & np.uint64(63))
    half = (word & np.uint64(1)).astype(bool)
    for k, side in enumerate((half, ~half)):
        np.bitwise_xor.at(out[k], row[side], bit[side])
    return out


_PACKED = "part long, a int, b int, chunks int, cls binary, size binary, sketch binary, at binary, key binary"


def _entries(chains, parts: int, chunks: np.ndarray):
    """Packed chains of every batch, one row for each part. ``chunks``: into how many chunks a key bucket's classes go."""
    base = parts + np.concatenate([[0], np.cumsum(np.where(chunks > 1, chunks * chunks, 0))[:-1]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cls, word, size in _slices(batch):
                sketch = _sketches(word, size)
                row, key = (np.concatenate(x) for x in zip(*chains(word, size)))
                bucket = (key >> np.uint64(48)).astype("int64")
                split = chunks[bucket] > 1
                out: list[tuple] = []

                def send(pick: np.ndarray, part: int, a: int = 0, b: int = 0, n: int = 1) -> None:
                    who, at = np.unique(row[pick], return_inverse=True)
                    low = key[pick].astype("uint32")
                    out.append((part, a, b, n, cls[who].tobytes(), size[who].astype("int32").tobytes(), sketch[:, who].tobytes(), at.astype("uint32" if len(who) > 65536 else "uint16").tobytes(), low.tobytes()))

                cold = np.flatnonzero(~split)
                part = (((key[cold] >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype("int64")
                order = np.argsort(part, kind="stable")
                cold, part = cold[order], part[order]
                for picked in np.split(cold, np.flatnonzero(np.diff(part)) + 1) if len(cold) else []:
                    send(picked, int((int(key[picked[0]]) >> 32) * parts >> 32))
                hot = np.flatnonzero(split)
                for u in np.unique(bucket[hot]):
                    n = int(chunks[u])
                    mine = hot[bucket[hot] == u]
                    chunk = _chunk(cls[row[mine]], n)
                    for c in np.unique(chunk):
                        for other in range(n):
                            a, b = min(c, other), max(c, other)
                            send(mine[chunk == c], int(base[u] + a * n + b), int(a), int(b), n)
                if out:
                    columns = list(zip(*out))
                    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 5]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in _PACKED.split(", ")])

    return run


def _chunk(cls: np.ndarray, n: int) -> np.ndarray:
    return (_mix(cls.view("uint64")) % np.uint64(n)).astype("int64")


def _meetings(similar: tuple[int, int]):
    """Pairs of classes of one part that share a chain and whose sketches and sizes allow the similarity."""
    part, whole = similar

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        cls, size, s0, s1, at, key, seen = [], [], [], [], [], [], 0
        for c, n, s, i, k in zip(*(rows[x] for x in ("cls", "size", "sketch", "at", "key"))):
            own = np.frombuffer(c, "int64")
            low = np.frombuffer(k, "uint32")
            sketch = np.frombuffer(s, "uint64").reshape(2, -1)
            cls.append(own)
            size.append(np.frombuffer(n, "int32"))
            s0.append(sketch[0])
            s1.append(sketch[1])
            at.append(np.frombuffer(i, "uint16" if len(i) == 2 * len(low) else "uint32").astype("int64") + seen)
            key.append(low)
            seen += len(own)
        cls, size, s0, s1, at, key = (np.concatenate(x) for x in (cls, size, s0, s1, at, key))
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        size, s0, s1, own = size[at], s0[at], s1[at], cls[at]
        n_chunks, first, second = rows["chunks"][0], rows["a"][0], rows["b"][0]
        chunk = _chunk(own, n_chunks) if n_chunks > 1 else None
        lefts: list[np.ndarray] = []
        rights: list[np.ndarray] = []

        def check(i, j) -> np.ndarray:
            differ = np.bitwise_count(s0[i] ^ s0[j]).astype("int32") + np.bitwise_count(s1[i] ^ s1[j])
            good = differ * (whole + part) <= (size[i] + size[j]) * (whole - part)
            good &= (size[i] * whole >= size[j] * part) & (size[j] * whole >= size[i] * part) & (own[i] != own[j])
            if chunk is not None and first != second:
                good &= chunk[i] != chunk[j]
            return good

        def keep(i: np.ndarray, j: np.ndarray) -> None:
            lefts.append(np.minimum(own[i], own[j]))
            rights.append(np.maximum(own[i], own[j]))

        ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
        starts = np.append(0, ends[:-1])
        length = ends - starts
        # Short lists: all entries with the entry d places on; long ones: block against block.
        short = np.repeat(length <= 48, length)
        last = np.repeat(ends, length)
        i, d = np.flatnonzero(short), 1
        while len(i := i[i + d < last[i]]):
            good = i[check(i, i + d)]
            keep(good, good + d)
            d += 1
        for a, b in zip(starts[length > 48].tolist(), ends[length > 48].tolist()):
            for x in range(a, b, 1024):
                i = np.arange(x, min(x + 1024, b))[:, None]
                for y in range(x, b, 1024):
                    j = np.arange(y, min(y + 1024, b))[None, :]
                    p, q = np.nonzero(check(i, j) & (i < j))
                    keep(p + x, q + y)
        left, right = np.concatenate([np.zeros(0, "int64"), *lefts]), np.concatenate([np.zeros(0, "int64"), *rights])
        order = np.lexsort((right, left))
        left, right = left[order], right[order]
        new = np.ones(len(left), bool)
        new[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
        return pa.table({"cls_a": left[new], "cls_b": right[new]})

    return run


def similar_classes(sets: DataFrame, similar: tuple[int, int] = SIMILAR, least: int = LEAST_WORDS) -> tuple[DataFrame, DataFrame]:
    """Classes of equal sets: members (``cls, id``) and links ``cls_a < cls_b`` of all similar classes.

    ``sets`` as from ``word_sets``. The class table is written once, so its numbers stay the same.
    """
    part, whole = similar
    sets = cut_lineage(sets)
    distinct = sets.groupBy("d0", "d1").agg(F.first("words").alias("words"))
    classes = cut_lineage(distinct.select(F.monotonically_increasing_id().alias("cls"), "words", "d0", "d1"))
    members = cut_lineage(sets.select("id", "d0", "d1").distinct().join(classes.select("cls", "d0", "d1"), ["d0", "d1"]).select("cls", "id"))
    discard(sets)
    classes = classes.select("cls", "words")
    weights, enough = word_weights(classes)
    chains = lambda word, size: _chains(word, size, weights, enough, similar, least)

    def listed(batch: pa.RecordBatch) -> np.ndarray:
        keys = (key for _, word, size in _slices(batch) for _, key in chains(word, size))
        return sum((np.bincount((k >> np.uint64(48)).astype("int64"), minlength=BUCKETS) for k in keys), np.zeros(BUCKETS, "int64"))

    n = _totals(classes, listed)
    total = int(n.sum())
    parts = max(1, -(-total // PART))
    # A bucket with far more chains than the others and than a part should take has a hot chain.
    hot = (n > PART // 4) & (n > 4 * total // BUCKETS)
    chunks = np.where(hot, np.maximum(2, -(-2 * n // PART)), 1)
    packed = classes.mapInArrow(_entries(chains, parts, chunks), _PACKED)
    met = packed.groupBy("part").applyInArrow(_meetings(similar), "cls_a long, cls_b long").distinct()
    of = lambda s: classes.select(F.col("cls").alias(f"cls_{s}"), F.col("words").alias(f"words_{s}"))
    met = met.join(of("a"), "cls_a").join(of("b"), "cls_b").withColumn("common", F.size(F.array_intersect("words_a", "words_b")))
    links = met.where(F.col("common") * whole >= (F.size("words_a") + F.size("words_b") - F.col("common")) * part)
    return members, links.select("cls_a", "cls_b")


def similar_pairs(df: DataFrame, id_col: str, texts: list[str], similar: tuple[int, int] = SIMILAR, least: int = LEAST_WORDS) -> DataFrame:
    """All pairs ``<id>_a < <id>_b`` of distinct ids whose word sets reach the similarity.

    Null texts are empty; records with too few words or a null id take no part; repeated rows count once; an empty table
    gives no pairs. Extra columns are ignored.
    """
    members, links = similar_classes(word_sets(df, id_col, texts, least), similar, least)
    alone = members.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    pairs = links.unionByName(alone.select(F.col("cls").alias("cls_a"), F.col("cls").alias("cls_b")))
    for s in "ab":
        pairs = attach_members(pairs, members.withColumnRenamed("cls", f"cls_{s}"), f"cls_{s}", f"id_{s}")
    pairs = pairs.where(F.col("id_a") != F.col("id_b"))
    return pairs.select(F.least("id_a", "id_b").alias(f"{id_col}_a"), F.greatest("id_a", "id_b").alias(f"{id_col}_b")).distinct()


def similar_groups(df: DataFrame, id_col: str, texts: list[str], similar: tuple[int, int] = SIMILAR, least: int = LEAST_WORDS) -> DataFrame:
    """Each id with enough words: ``<id>, group_id, n_links``: ids linked by a chain of similar pairs share the group.

    ``group_id`` is the group's least id; ``n_links`` counts the other classes that are similar to the id's own. An id with
    several texts comes out once per distinct class.
    """
    members, links = similar_classes(word_sets(df, id_col, texts, least), similar, least)
    links = cut_lineage(links)
    labels = connected_components(links.select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b")))
    degree = links.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("n_links"))
    rows = members.join(labels.withColumnRenamed("node", "cls"), "cls", "left").join(degree, "cls", "left")
    rows = rows.select("id", F.coalesce("label", "cls").alias("label"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    first = rows.groupBy("label").agg(F.min("id").alias("group_id"))
    return rows.join(first, "label").select(F.col("id").alias(id_col), "group_id", "n_links")
