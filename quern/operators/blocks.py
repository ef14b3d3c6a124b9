"""The best items of every query without a table of all pairs.

Items are packed in blocks, one compressed value each, in the folder that all executors share. A task takes some hundred
queries and goes through the blocks one by one, several times; only the items and scores of the result leave it. Fusion wants
each signal's rank among all items, and a task never holds more than one block, so ranks are found in exact steps:

1. *Marks*: one block of items gives each query and signal a few values, dense at the top. They only steer the next steps.
2. *Counts*: every block counts its items above and at each mark. Summed, they bracket the rank of any value.
3. *Candidates*: every block has bounds of each item's fused score, and the items whose upper bound reaches the k-th best
   lower bound so far are held. No item of the result can be missing.
4. *Ranks*: every block counts its items above and at each candidate's values. Summed, the candidates' ranks are exact.

Neither pairs nor candidates are shuffled or written. Several weightings are fused from the same ranks.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.ipc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quern.config import SCORES
from quern.functions.geo import EARTH_RADIUS_KM
from quern.functions.vectors import hash_vectors
from quern.plans.lineage import cut_lineage

#: Items and queries that are held at a time at most, queries that are worth a task, and marks of a signal.
ITEM_BLOCK, QUERY_BLOCK, LEAST_QUERIES = 65_536, 512, 32
MARKS = 28
#: Blocks that a worker keeps unpacked between steps and tasks; it reads the others again. Rows of a token from this share on are a mask.
KEPT, FREQUENT = 6, 1 / 16
#: Queries that meet a block of items at most where only their coverage is summed.
COVERAGE_QUERIES = 65_536
_N = len(SCORES)
_SIMILAR, _LOCATION, _KIND = 2, 3, 4
_QUERY = ["uid", "query_id", "filter_category", "search_location_id", "centroid_lat", "centroid_lon", "q_params", "q_text", "q_embedding"]
_ITEM = ["item_id", "item_category_id", "item_location_id", "lat", "lon", "item_microcat_id", "params", "texts", "embedding", "params_read"]


class _Postings:
    """Rows by token, for lists of distinct tokens."""

    def __init__(self, lists: pa.Array):
        codes = lists.flatten().dictionary_encode()
        self.code = {t: k for k, t in enumerate(codes.dictionary.to_pylist())}
        code = codes.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        self.rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))[order]
        self.starts = np.searchsorted(code[order], np.arange(len(self.code) + 1))
        self.n = len(lists)

    def of(self, token: str) -> np.ndarray:
        c = self.code.get(token)
        return self.rows[:0] if c is None else self.rows[self.starts[c] : self.starts[c + 1]]

    def matches(self, tokens: list[str], start: int, stop: int) -> np.ndarray:
        """How many of the distinct ``tokens`` each row from ``start`` to ``stop`` has."""
        found = np.zeros(stop - start, "int32")
        for t in tokens:
            rows = self.of(t)
            found[rows[slice(*np.searchsorted(rows, (start, stop)))] - start] += 1
        return found


def _filled(column: pa.Array, null) -> np.ndarray:
    return column.fill_null(null).to_numpy(zero_copy_only=False)


def _vectors(column: pa.Array) -> np.ndarray:
    """A column of float lists as (position, row) in double; null is a zero vector."""
    known = column.drop_null()
    dim = len(known[0]) if len(known) else 0
    out = np.zeros((dim, len(column)))
    at = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    out[:, at] = known.flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim).T if len(at) else 0.0
    return out


class _Tokens:
    """Postings of a block as they were packed, by sorted tokens; the rows of frequent tokens come as masks."""

    def __init__(self, tokens: pa.Array, starts: np.ndarray, rows: np.ndarray, n: int):
        self.tokens, self.starts, self.rows, self.n = tokens, starts, rows, n
        self.code: dict[str, int | None] = {}
        self.masks: dict[int, np.ndarray] = {}

    def at(self, token: str) -> int | None:
        """The token's number. A block's tokens are far more than a task's queries have, so only those are looked up."""
        if token not in self.code:
            n = bisect_left(range(len(self.tokens)), token, key=lambda k: self.tokens[k].as_py())
            self.code[token] = n if n < len(self.tokens) and self.tokens[n].as_py() == token else None
        return self.code[token]

    def matches(self, tokens: list[str], start: int, stop: int) -> np.ndarray:
        """How many of the distinct ``tokens`` each row from ``start`` to ``stop`` has."""
        found = np.zeros(stop - start, "uint8" if len(tokens) < 256 else "int32")
        for t in tokens:
            if (c := self.at(t)) is None:
                continue
            rows = self.rows[self.starts[c] : self.starts[c + 1]]
            if len(rows) > self.n * FREQUENT:
                if c not in self.masks:
                    self.masks[c] = np.zeros(self.n, "uint8")
                    self.masks[c][rows] = 1
                found += self.masks[c][start:stop]
            else:
                found[rows[slice(*np.searchsorted(rows, (start, stop)))] - start] += 1
        return found


class _Block:
    """A block of items in arrays, sorted by category with the unknown ones last, and the scores of a query against them."""

    def __init__(self, table: pa.Table, decay_km: float):
        c = {n: table.column(n).combine_chunks()[0].values for n in table.column_names}
        numbers = lambda name: c[name].to_numpy(zero_copy_only=False)
        self.decay = decay_km
        self.ids = c["item_id"]
        self.carried = {n[8:]: x for n, x in c.items() if n.startswith("carried_")}
        self.n = len(self.ids)
        self.category = c["item_category_id"].drop_null().to_numpy(zero_copy_only=False)
        self.place, self.has_place = _filled(c["item_location_id"], 0), c["item_location_id"].is_valid().to_numpy(zero_copy_only=False)
        lat, lon = (_filled(c[x], float("nan")) for x in ("lat", "lon"))
        self.lat, self.lon, self.cos = lat, lon, np.cos(np.radians(lat))
        self.params, self.texts = (_Tokens(c[f"{x}_tokens"], numbers(f"{x}_starts"), numbers(f"{x}_rows"), self.n) for x in ("params", "texts"))
        shaped = lambda name, n: numbers(name).reshape(-1, n) if n else np.zeros((0, 0), "float32")
        self.vectors = shaped("vectors", self.n)
        self.kind = numbers("kind").astype("int64")
        self.centroids = shaped("centroids", int(self.kind.max()) + 1 if self.n else 0).astype("float64")
        self.room = np.empty((2, self.n))
        self.here: tuple = (None, None, None)
        self.known: dict = {}

    def span(self, c) -> tuple[int, int]:
        """The rows behind the category filter."""
        return (0, self.n) if c is None else tuple(int(x) for x in (np.searchsorted(self.category, c, "left"), np.searchsorted(self.category, c, "right")))

    def location(self, q: dict, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """Score and distance of the rows; queries of one place and category share them if they follow each other."""
        key = q["search_location_id"], start, stop
        if self.here[1] is None or self.here[0] != key:
            of = slice(start, stop)
            same = self.has_place[of] & (self.place[of] == key[0]) if key[0] is not None else np.zeros(stop - start, bool)
            lat, lon = (float("nan") if q[x] is None else q[x] for x in ("centroid_lat", "centroid_lon"))
            a, b = np.sin(np.radians(self.lat[of] - lat) / 2), np.sin(np.radians(self.lon[of] - lon) / 2)
            h = np.clip(a * a + np.cos(np.radians(lat)) * self.cos[of] * b * b, 0.0, 1.0)
            km = 2 * EARTH_RADIUS_KM * np.arcsin(np.sqrt(h))
            near = np.where(same, 1.0, np.nan_to_num(np.exp(-km / self.decay), nan=0.0))
            self.here = key, near.astype("float32"), np.where(same, 0.0, km).astype("float32")
        return self.here[1:]

    def matches(self, q: dict, start: int, stop: int) -> list[np.ndarray]:
        """How many of the query's params and of its words each row has."""
        return [self.params.matches(q["q_params"], start, stop), self.texts.matches(q["q_text"], start, stop)]

    def similar(self, q: dict, start: int, stop: int) -> np.ndarray:
        # Terms in index order, in double, as any engine adds them; zeros add nothing.
        total, term = self.room[:, : stop - start]
        total.fill(0.0)
        for j, v in q["sparse"]:
            if j < len(self.vectors):
                np.multiply(self.vectors[j, start:stop], v, out=term, dtype="float64")
                total += term
        return total.astype("float32")

    def kinds(self, q: dict) -> np.ndarray:
        """The score of each kind of the block, of which ``kind`` has the number."""
        total = np.zeros(self.centroids.shape[1])
        for j, v in q["sparse"]:
            if j < len(self.centroids):
                total += v * self.centroids[j]
        return total.astype("float32")

    def rising_kinds(self, q: dict, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """The scores of the kinds in rising order, and how many rows come before each and in all."""
        if (start, stop) not in self.known:
            n = np.bincount(self.kind[start:stop], minlength=self.centroids.shape[1])
            there = np.flatnonzero(n)
            self.known[start, stop] = there, n[there]
        there, n = self.known[start, stop]
        values = self.kinds(q)[there]
        order = np.argsort(values)
        return values[order], np.concatenate([[0], np.cumsum(n[order])])


def _stream(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _files(uri: str) -> list[tuple]:
    """File system and path of each file of a table in the shared folder, always in one order."""
    import pyarrow.fs

    files, path = pyarrow.fs.FileSystem.from_uri(uri.replace("file:", "file://", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)
    return [(files, one) for one in sorted(x.path for x in files.get_file_info(pyarrow.fs.FileSelector(path)) if x.base_name.endswith(".parquet"))]


def _read(file: tuple, column: str) -> pa.ChunkedArray:
    import pyarrow.parquet

    with file[0].open_input_file(file[1]) as source:
        return pyarrow.parquet.ParquetFile(source).read([column]).column(0)


def _shared(uri: str, columns: list[str], rows: int, wanted: list | None = None) -> Iterator[pa.RecordBatch]:
    """A table in the shared folder, by batches of ``rows``, always in one order. Parts whose first column has none of the
    values ``wanted``, by its least and greatest, are left out."""
    import pyarrow.parquet

    for files, one in _files(uri):
        with files.open_input_file(one) as source:
            file = pyarrow.parquet.ParquetFile(source)
            parts = range(file.num_row_groups)
            if wanted is not None:
                place = file.schema_arrow.get_field_index(columns[0])
                bounds = [file.metadata.row_group(n).column(place).statistics for n in parts]
                parts = [n for n, s in zip(parts, bounds) if s is None or not s.has_min_max or any(s.min <= x <= s.max for x in wanted)]
            yield from file.iter_batches(rows, row_groups=list(parts), columns=columns)


def _relevant(uri: str, candidates: dict[str, set]) -> dict[str, set]:
    """Of each query's candidates those that a table (query_id, item_id) in the shared folder has."""
    out: dict[str, set] = {q: set() for q in candidates}
    if candidates:
        asked, ids = pa.array(list(candidates), pa.string()), pa.array(list(set().union(*candidates.values())), pa.string())
        for batch in _shared(uri, ["query_id", "item_id"], 65_536, list(candidates)):
            part = batch.filter(pc.and_(pc.is_in(batch.column("query_id"), asked), pc.is_in(batch.column("item_id"), ids)))
            for q, i in zip(part.column("query_id").to_pylist(), part.column("item_id").to_pylist()):
                if i in candidates[q]:
                    out[q].add(i)
    return out


def _near(table: pa.Table, asked: str, threshold: float) -> dict[str, np.ndarray]:
    """Rows whose params are near a token of the queries (token, embedding in the shared folder), by token."""
    read = hash_vectors(table.column("params_read").combine_chunks()).astype("float64")
    out: dict[str, np.ndarray] = {}
    for words in _shared(asked, ["token", "embedding"], 10_000):
        v, which = np.unique(_vectors(words.column("embedding")), axis=1, return_inverse=True)
        rows = [np.flatnonzero((read @ v[:, k]).astype("float32") >= np.float32(threshold)) for k in range(v.shape[1])]
        out |= {t: rows[k] for t, k in zip(words.column("token").to_pylist(), which.ravel()) if len(rows[k])}
    return out


def _pack(table: pa.Table, centroids: str, asked: str | None, threshold: float, carried: list[str]) -> pa.Table:
    """A block as one value: columns of arrays, tokens with the rows that have them, each kind's centroid once, all compressed."""
    table = table.sort_by("item_category_id")
    c = {n: table.column(n).combine_chunks() for n in _ITEM}
    columns = {n: c[n] for n in ("item_id", "item_category_id", "item_location_id")} | {x: c[x].cast(pa.float64()) for x in ("lat", "lon")}
    for name in ("params", "texts"):
        held = _Postings(c[name])
        by = {t: held.of(t) for t in sorted(held.code)}
        if name == "params" and asked is not None:
            by |= {t: np.union1d(rows, by.get(t, rows[:0])) for t, rows in _near(table, asked, threshold).items()}
            by = {t: by[t] for t in sorted(by)}
        starts = np.concatenate([[0], np.cumsum([len(x) for x in by.values()])])
        columns |= {f"{name}_tokens": pa.array(list(by), pa.string()), f"{name}_starts": pa.array(starts, pa.int32()), f"{name}_rows": pa.array(np.concatenate([np.zeros(0, "int64"), *by.values()]), pa.int32())}
    kind = c["item_microcat_id"].dictionary_encode(null_encoding="encode")
    at = {k: n for n, k in enumerate(kind.dictionary.to_pylist())}
    found: dict[int, np.ndarray] = {}
    for part in _shared(centroids, ["item_microcat_id", "centroid"], 10_000):
        v = _vectors(part.column("centroid"))
        found |= {at[k]: v[:, n] for n, k in enumerate(part.column("item_microcat_id").to_pylist()) if k in at}
    dim = max([0, *map(len, found.values())])
    of_kind = np.array([found[k] if len(found.get(k, ())) else np.zeros(dim) for k in range(len(at))], "float32").reshape(len(at), dim).T
    columns |= {"vectors": pa.array(_vectors(c["embedding"]).astype("float32").ravel()), "kind": pa.array(kind.indices, pa.int32()), "centroids": pa.array(of_kind.ravel())}
    columns |= {f"carried_{n}": table.column(n).combine_chunks() for n in carried}
    whole = pa.table({n: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for n, x in columns.items()})
    bounds = pc.min_max(c["item_category_id"])
    return pa.table({"least": pa.array([bounds["min"].as_py()], pa.int64()), "most": pa.array([bounds["max"].as_py()], pa.int64()), "block": pa.array([_stream(whole)], pa.binary())})


def _packed(batches: Iterator[pa.RecordBatch], pack) -> Iterator[pa.RecordBatch]:
    """A partition's items in blocks of up to ``ITEM_BLOCK``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for start in range(0, batch.num_rows, ITEM_BLOCK):
            part = batch.slice(start, ITEM_BLOCK)
            if held and sum(x.num_rows for x in held) + part.num_rows > ITEM_BLOCK:
                yield from pack(pa.Table.from_batches(held)).to_batches()
                held = []
            held.append(part)
    if held:
        yield from pack(pa.Table.from_batches(held)).to_batches()


class _Corpus:
    """The blocks of a table in the shared folder, one at a time, always in one order; some are kept."""

    def __init__(self, uri: str, decay_km: float):
        self.uri, self.decay = uri, decay_km
        self.kept: dict[int, _Block] = {}
        #: File and place in it of each block, and its least and greatest category.
        self.places = [(f, n, *bounds) for f in _files(uri) for n, bounds in enumerate(zip(*(_read(f, c).to_pylist() for c in ("least", "most"))))]

    def __call__(self, categories: set) -> Iterator[tuple[int, _Block]]:
        """The blocks, by number, that may have items of one of the ``categories``; null asks for all."""
        needed = [n for n, (_, _, least, most) in enumerate(self.places) if None in categories or (least is not None and any(least <= c <= most for c in categories))]
        keep = set(needed[:KEPT])
        self.kept = {n: x for n, x in self.kept.items() if n in keep}
        for n in needed:
            block = self.kept.get(n)
            if block is None:
                file, row = self.places[n][:2]
                block = _Block(pa.ipc.open_stream(_read(file, "block")[row].as_buffer()).read_all(), self.decay)
                if n in keep:
                    self.kept[n] = block
            yield n, block


_opened: list[_Corpus] = []


def _corpus(uri: str, decay_km: float) -> _Corpus:
    """The one that this worker has open, so that its next task finds the kept blocks; the last table only."""
    if not _opened or (_opened[0].uri, _opened[0].decay) != (uri, decay_km):
        _opened[:] = [_Corpus(uri, decay_km)]
    return _opened[0]


def _marked(rising: np.ndarray, before: np.ndarray) -> np.ndarray:
    """A few values of one signal, rising, dense at the top."""
    n = int(before[-1])
    at = np.unique(np.minimum(n - 1, np.floor(np.geomspace(1, max(2, n), MARKS) - 1).astype("int64"))) if n else np.zeros(0, "int64")
    return np.unique(rising[np.searchsorted(before, n - 1 - at, "right") - 1])


def _counts(rising: np.ndarray, before: np.ndarray | None, marks: np.ndarray) -> np.ndarray:
    """How many rows are above, and at or above, each of the rising ``marks``; without ``before`` a value is a row."""
    at = np.array([np.searchsorted(rising, marks, side) for side in ("right", "left")])
    return len(rising) - at if before is None else before[-1] - before[at]


def _bounds(n: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Best and worst possible average rank by interval: 2 k lies below mark k and above the mark before, 2 k + 1 is mark k."""
    above, least = n
    best, worst = np.ones(2 * len(least) + 1), np.full(2 * len(least) + 1, float(total))
    # Between two marks: below all values at or above the higher one, above all at or below the lower one.
    best[:-1:2] = least + 1.0
    worst[2::2] = above
    worst = np.maximum(best, worst)
    best[1::2] = worst[1::2] = above + (least - above + 1) / 2.0
    return best, worst


def _average(counts: np.ndarray) -> np.ndarray:
    """Average rank of rows by their number of matches, from how many rows have each number."""
    return np.cumsum(counts[::-1])[::-1] - counts + (counts + 1) / 2.0


def _share(tokens: list[str]) -> np.ndarray:
    return (np.arange(len(tokens) + 1) / max(1, len(tokens))).astype("float32")


def _interval(values: np.ndarray, marks: np.ndarray) -> np.ndarray:
    if not len(marks):
        return np.zeros(len(values), "int64")
    at = np.searchsorted(marks, values)
    return 2 * at + (marks.take(at, mode="clip") == values)


def _fused(ranks: list[np.ndarray], constant: np.ndarray, weights: list[float], k: int) -> np.ndarray:
    total = np.zeros(len(ranks[0]))
    for s in range(_N):
        if weights[s] and not constant[s]:
            total = total + weights[s] / (k + ranks[s])
    return total


def _pack_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's items (ts, and embedding if there is one) as blocks of up to ``ITEM_BLOCK``, one value each."""
    import pyspark

    def packed(held: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        ts = table.column("ts").combine_chunks()
        table = table.set_column(table.column_names.index("ts"), "ts", pa.ListArray.from_arrays(ts.offsets, ts.flatten().dictionary_encode()))
        ib = (pyspark.TaskContext.get().partitionId() << 32) + number
        return pa.RecordBatch.from_pydict({"ib": pa.array([ib], pa.int64()), "block": pa.array([_stream(table)], pa.binary())})

    held: list[pa.RecordBatch] = []
    number = 0
    for batch in batches:
        for start in range(0, batch.num_rows, ITEM_BLOCK):
            part = batch.slice(start, ITEM_BLOCK)
            if held and sum(x.num_rows for x in held) + part.num_rows > ITEM_BLOCK:
                yield packed(held, number)
                held, number = [], number + 1
            held.append(part)
    if held:
        yield packed(held, number)


def coverage_totals(queries: DataFrame, items: DataFrame, query_id: str, vocabulary: DataFrame | None = None, threshold: float = 0.0) -> DataFrame:
    """``<query_id>, n_items, best, total``: how many items share a token with the query, the highest coverage (float) and the
    sum. ``queries`` (id, ts) and ``items`` (ts) have arrays of distinct tokens; a query without a match doesn't come out.

    With ``vocabulary`` (token, embedding), items have an embedding, too, and a token also counts as theirs where the product
    of the two, as float, reaches ``threshold``. Blocks of items, each one compressed value, meet large blocks of queries and
    of the vectors of their tokens; neither pairs nor matches come out of a task, each query gets three numbers.
    """
    spark = queries.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    q_blocks = max(1, -(-queries.count() // COVERAGE_QUERIES))
    blocks = cut_lineage(items.mapInArrow(_pack_sets, "ib long, block binary"))
    groups = max(1, q_blocks * blocks.count())
    zero = F.lit(0).cast("long")
    q = queries.select(F.lit(True).alias("asks"), F.col(query_id).alias("q"), "ts", F.lit(None).cast("array<float>").alias("v")).withColumn("qb", F.pmod(F.xxhash64("q"), F.lit(q_blocks)))
    if vocabulary is not None:
        used = q.select("qb", F.explode("ts").alias("token")).distinct().join(vocabulary.where("embedding IS NOT NULL"), "token")
        q = q.unionByName(used.select(F.lit(False).alias("asks"), F.lit(None).cast(q.schema["q"].dataType).alias("q"), F.array("token").alias("ts"), F.col("embedding").alias("v"), "qb"))
    q = q.crossJoin(F.broadcast(blocks.select((F.col("ib") + 0).alias("ib"))))
    i = blocks.withColumn("qb", F.explode(F.sequence(zero, zero + (q_blocks - 1))))
    names, kinds = ["q", "n", "best", "total"], [dict(queries.dtypes)[query_id], "long", "float", "double"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            block = pa.ipc.open_stream(right.column("block")[0].as_buffer()).read_all()
            postings = _Postings(block.column("ts").combine_chunks())
            known: dict[str, np.ndarray] = {}
            words = left.filter(pc.invert(left.column("asks")))
            if words.num_rows:
                vectors = _vectors(block.column("embedding").combine_chunks())
                usable = np.flatnonzero(block.column("embedding").combine_chunks().is_valid().to_numpy(zero_copy_only=False))
                of = _vectors(words.column("v").combine_chunks())
                for at, (token,) in enumerate(words.column("ts").to_pylist()):
                    similar = np.zeros(postings.n)
                    for j in np.flatnonzero(of[:, at])[: len(vectors)]:
                        similar += of[j, at] * vectors[j]
                    near = usable[similar[usable].astype("float32") >= np.float32(threshold)]
                    known[token] = np.union1d(near, postings.of(token))
            seen: dict[tuple, tuple] = {}
            for row, (asks, tokens) in enumerate(zip(left.column("asks").to_pylist(), left.column("ts").to_pylist())):
                if not asks:
                    continue
                if (key := tuple(tokens)) not in seen:
                    rows = np.concatenate([known[t] if t in known else postings.of(t) for t in tokens])
                    # Of a few rows only the rows are counted, of many all items.
                    each = np.bincount(rows) if 8 * len(rows) > postings.n else np.unique(rows, return_counts=True)[1]
                    by_count = np.bincount(each, minlength=len(tokens) + 1)
                    scores = (np.arange(len(tokens) + 1) / len(tokens)).astype("float32")
                    seen[key] = int(by_count[1:].sum()), scores[np.flatnonzero(by_count)[-1]] if len(rows) else 0, float((scores.astype("float64") * by_count).sum())
                if seen[key][0]:
                    out.append((row, *seen[key]))
        at, n, best, total = zip(*out) if out else ((), (), (), ())
        return pa.table({"q": left.column("q").take(pa.array(at, pa.int64())), "n": pa.array(n, pa.int64()), "best": pa.array(best, pa.float32()), "total": pa.array(total, pa.float64())})

    keyed = lambda df: df.repartition(min(2 * groups, 4 * tasks), "qb", "ib").groupBy("qb", "ib")
    done = keyed(q).cogroup(keyed(i)).applyInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))
    return done.groupBy(F.col("q").alias(query_id)).agg(F.sum("n").alias("n_items"), F.max("best").alias("best"), F.sum("total").alias("total"))


class _Held:
    """The candidates of one query so far: places (block, row), scores, distances, and bounds of the fused scores."""

    def __init__(self, n: int):
        self.parts: list[tuple] = []
        self.bar = np.full(n, -np.inf)
        self.waiting = 0

    def add(self, block: int, rows: np.ndarray, s: np.ndarray, km: np.ndarray, low: np.ndarray, high: np.ndarray, top_k: int) -> None:
        self.parts.append((np.full(len(rows), block), rows, s, km, low, high))
        self.waiting += len(rows)
        if self.waiting > top_k:
            self.trim(top_k)

    def trim(self, top_k: int) -> None:
        self.waiting = 0
        if not self.parts:
            return
        whole = [np.concatenate(x, -1) for x in zip(*self.parts)]
        low, high = whole[4:]
        if low.shape[1] > top_k:
            self.bar = np.maximum(self.bar, np.partition(low, low.shape[1] - top_k, axis=1)[:, low.shape[1] - top_k])
        keep = (high >= self.bar[:, None] * (1 - 1e-12)).any(0)
        self.parts = [tuple(x[..., keep] for x in whole)]


def _ranked(queries: list[dict], blocks, weightings: list[list[float]], top_k: int, rrf_k: int, carried: list[str] = [], said: dict[str, pa.DataType] = {}, labelled: bool = False, known: str | None = None) -> Iterator[pa.Table]:
    """The result's columns for ``queries``; ``blocks(categories)`` goes through the blocks of items. They are followed by the items'
    ``carried`` columns, the queries' ``said`` columns, and with ``labelled`` by 1 for the query's ``relevant`` items, else 0;
    of queries without such a list the relevant ones are in the table ``known``.

    Coverages have few values, so their ranks are exact once the rows with each number of matches are counted. What depends
    on the place and the category only is done once for all queries that share them (a group).
    """
    queries = sorted(queries, key=lambda q: tuple(x for c in ("filter_category", "search_location_id") for x in (q[c] is None, q[c] or 0)))
    categories = {q["filter_category"] for q in queries}
    groups: list[tuple] = []
    for i, q in enumerate(queries):
        q["sparse"] = [(j, v) for j, v in enumerate(q["q_embedding"] or []) if v]
        key = q["search_location_id"], q["filter_category"]
        if not groups or groups[-1][0] != key:
            groups.append((key, []))
        groups[-1][1].append(i)
    n_q, none = len(queries), np.zeros(0, "float32")
    spans = lambda block: ((queries[members[0]], members, *block.span(key[1])) for key, members in groups)
    rows = lambda values: np.arange(len(values) + 1)
    marks = [[none] * _N for _ in queries]
    unmarked = {members[0] for _, members in groups}
    for _, block in blocks(categories):
        for first, members, a, b in spans(block):
            if a == b or members[0] not in unmarked:
                continue
            unmarked.discard(members[0])
            near = np.sort(block.location(first, a, b)[0])
            place = _marked(near, rows(near))
            for i in members:
                s = block.similar(queries[i], a, b)
                s.sort()
                marks[i][_SIMILAR], marks[i][_LOCATION], marks[i][_KIND] = _marked(s, rows(s)), place, _marked(*block.rising_kinds(queries[i], a, b))
        if not unmarked:
            break
    counts = [[np.zeros(len(q["q_params"]) + 1, "int64"), np.zeros(len(q["q_text"]) + 1, "int64"), *(np.zeros((2, len(m)), "int64") for m in marks[i][_SIMILAR:])] for i, q in enumerate(queries)]
    low, high, total = np.full((n_q, _N), np.inf), np.full((n_q, _N), -np.inf), np.zeros(n_q, "int64")
    for _, block in blocks(categories):
        for first, members, a, b in spans(block):
            if a == b:
                continue
            near = np.sort(block.location(first, a, b)[0])
            place = _counts(near, None, marks[members[0]][_LOCATION])
            for i in members:
                q = queries[i]
                total[i] += b - a
                for k, m in enumerate(block.matches(q, a, b)):
                    counts[i][k] += np.bincount(m, minlength=len(counts[i][k]))
                s = block.similar(q, a, b)
                s.sort()
                rising, before = block.rising_kinds(q, a, b)
                counts[i][_SIMILAR] += _counts(s, None, marks[i][_SIMILAR])
                counts[i][_LOCATION] += place
                counts[i][_KIND] += _counts(rising, before, marks[i][_KIND])
                for k, x in ((_SIMILAR, s), (_LOCATION, near), (_KIND, rising)):
                    low[i, k], high[i, k] = min(low[i, k], x[0]), max(high[i, k], x[-1])
    constant = low == high
    tables: list[list] = []
    for i in range(n_q):
        for k in range(_SIMILAR):
            constant[i, k] = np.count_nonzero(counts[i][k]) == 1
        ranks = [(r := _average(counts[i][k]), r) if k < _SIMILAR else _bounds(counts[i][k], int(total[i])) for k in range(_N)]
        # Of each weighting and signal the best and the worst share of the fused score, by number of matches or interval.
        tables.append([[[w[k] / (rrf_k + r) if w[k] and not constant[i, k] else np.zeros(len(r)) for r in ranks[k]] for k in range(_N)] for w in weightings])
    # Similarities from this mark on are looked at one by one; those below it have this place at best.
    steep = [int(np.searchsorted(-counts[i][_SIMILAR][1], -(total[i] // 32))) for i in range(n_q)]
    held = [_Held(len(weightings)) for _ in queries]
    for number, block in blocks(categories):
        for first, members, a, b in spans(block):
            if a == b:
                continue
            near, km = block.location(first, a, b)
            at_place = _interval(near, marks[members[0]][_LOCATION])
            place = [[of[_LOCATION][x][at_place] for x in range(2)] for of in tables[members[0]]]
            kind = block.kind[a:b]
            for i in members:
                q, bar = queries[i], held[i].bar
                params, texts = block.matches(q, a, b)
                width = len(q["q_text"]) + 1
                both = np.multiply(params, width, dtype="int64") + texts
                s, kinds = block.similar(q, a, b), block.kinds(q)
                at_kind = _interval(kinds, marks[i][_KIND])
                rest = []
                for of, p in zip(tables[i], place):
                    rest.append((of[0][0][:, None] + of[1][0]).ravel().take(both, mode="clip"))
                    rest[-1] += of[_KIND][0][at_kind].take(kind, mode="clip")
                    rest[-1] += p[0]

                def lowest(at, i=i, both=both, s=s, at_kind=at_kind) -> np.ndarray:
                    seen = _interval(s[at], marks[i][_SIMILAR])
                    return np.array([(of[0][0][:, None] + of[1][0]).ravel()[both[at]] + of[_KIND][1][at_kind][kind[at]] + p[1][at] + of[_SIMILAR][1][seen] for of, p in zip(tables[i], place)])

                if b - a > top_k and np.isneginf(bar).any():
                    bar = np.partition(lowest(slice(None)), b - a - top_k, axis=1)[:, b - a - top_k]
                bar = bar * (1 - 1e-12)
                keep = s >= marks[i][_SIMILAR][steep[i]] if steep[i] < len(marks[i][_SIMILAR]) else np.zeros(b - a, bool)
                for v, of in enumerate(tables[i]):
                    keep |= rest[v] >= bar[v] - of[_SIMILAR][0][2 * steep[i]]
                at = np.flatnonzero(keep)
                seen = _interval(s[at], marks[i][_SIMILAR])
                upper = np.array([rest[v][at] + of[_SIMILAR][0][seen] for v, of in enumerate(tables[i])])
                keep = (upper >= bar[:, None]).any(0)
                at, upper = at[keep], upper[:, keep]
                if len(at):
                    scores = np.array([_share(q["q_params"])[params[at]], _share(q["q_text"])[texts[at]], s[at], near[at], kinds[kind[at]]], "float32")
                    held[i].add(number, at + a, scores, km[at], lowest(at), upper, top_k)
    del tables
    wanted, back = [], []
    for h in held:
        h.trim(top_k)
        pairs = [np.unique(x, return_inverse=True) for x in (h.parts[0][2][_SIMILAR:] if h.parts else np.zeros((_N - _SIMILAR, 0), "float32"))]
        wanted.append([x[0] for x in pairs])
        back.append([x[1] for x in pairs])
    above = [[np.zeros((2, len(m)), "int64") for m in of] for of in wanted]
    ids = [np.empty(len(h.parts[0][0]) if h.parts else 0, object) for h in held]
    brought: list[list[tuple]] = [[] for _ in queries]
    for number, block in blocks(categories):
        for first, members, a, b in spans(block):
            if a == b:
                continue
            near = np.sort(block.location(first, a, b)[0])
            for i in members:
                if not len(ids[i]):
                    continue
                q = queries[i]
                s = block.similar(q, a, b)
                s.sort()
                for k, x in enumerate(((s, None), (near, None), block.rising_kinds(q, a, b))):
                    above[i][k] += _counts(*x, wanted[i][k])
                mine = np.flatnonzero(held[i].parts[0][0] == number)
                at = pa.array(held[i].parts[0][1][mine])
                ids[i][mine] = block.ids.take(at).to_numpy(zero_copy_only=False)
                if carried:
                    brought[i].append((mine, [block.carried[c].take(at) for c in carried]))
    found: dict[str, set] = {}
    if known is not None:
        for i, q in enumerate(queries):
            if q["relevant"] is None:
                found.setdefault(q["query_id"], set()).update(ids[i])
        found = _relevant(known, found)
    names = [x.split()[0] for x in _RESULT.split(", ")]
    for i, q in enumerate(queries):
        if not len(ids[i]):
            continue
        _, _, s, km, _, _ = held[i].parts[0]
        ranks = [_average(counts[i][k])[np.searchsorted(_share(q[c]), s[k])] for k, c in enumerate(("q_params", "q_text"))]
        ranks += [(n[0] + (n[1] - n[0] + 1) / 2.0)[back[i][k]] for k, n in enumerate(above[i])]
        for v, w in enumerate(weightings):
            fused = _fused(ranks, constant[i], w, rrf_k)
            order = np.lexsort((ids[i].astype(str), -fused))[:top_k]
            columns = [np.full(len(order), q["uid"]), pa.array([q["query_id"]] * len(order)), np.full(len(order), v), pa.array(ids[i][order], pa.string()), *(x[order] for x in s), pa.array(km[order], pa.float32(), from_pandas=True), fused[order], np.arange(1, len(order) + 1)]
            out = dict(zip(names, columns))
            if carried:
                place = np.argsort(np.concatenate([mine for mine, _ in brought[i]]))[order]
                out |= {c: pa.concat_arrays([x[n] for _, x in brought[i]]).take(pa.array(place)) for n, c in enumerate(carried)}
            out |= {c: pa.array([q[c]] * len(order), kind) for c, kind in said.items()}
            if labelled:
                relevant = found.get(q["query_id"], ()) if q["relevant"] is None else set(q["relevant"])
                out["label"] = pa.array([int(x in relevant) for x in ids[i][order]], pa.int32())
            yield pa.table(out)


_RESULT = "uid long, query_id string, variant long, item_id string, " + ", ".join(f"{c} float" for c in SCORES) + ", location_distance_km float, rrf_score double, rrf_rank long"


class BlockRanker:
    """Top items of every query under one or more weightings; ``queries`` and ``items`` hold ``_QUERY`` and ``_ITEM``.

    ``centroids`` (item_microcat_id, centroid) and ``asked`` (token, embedding) are tables in the shared folder. A token of
    ``asked`` also counts as a param of the items whose embedded params reach ``threshold``; without it none does.
    ``carried`` columns of the items and ``said`` columns of the queries come along with the rows, without a join, and so
    does ``label`` if the queries have a list ``relevant`` of item ids. Queries without one have theirs in ``known``
    (query_id, item_id), a table in the shared folder.
    """

    def __init__(self, queries: DataFrame, items: DataFrame, centroids: DataFrame, weightings: list[list[float]], top_k: int, rrf_k: int, decay_km: float, asked: DataFrame | None = None, threshold: float = 0.0, carried: list[str] = [], said: list[str] = [], known: DataFrame | None = None):
        spark = queries.sparkSession
        self.weightings, self.top_k, self.rrf_k, self.decay = weightings, top_k, rrf_k, decay_km
        n_queries, n_items = queries.count(), items.count()
        n_blocks = max(1, -(-n_items // ITEM_BLOCK))
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        size = min(QUERY_BLOCK, max(LEAST_QUERIES, -(-n_queries // (2 * tasks))))
        # Queries of one category and place come together and share their blocks and distances.
        self.carried, self.labelled = carried, "relevant" in queries.columns
        self.known = None if known is None else known._cut_at
        self.said = {c: to_arrow_type(queries.schema[c].dataType) for c in said}
        self.added = "".join(f", {c} {df.schema[c].dataType.simpleString()}" for df, names in ((items, carried), (queries, said)) for c in names) + ", label int" * self.labelled
        self.queries = queries.select(*_QUERY, *said, *["relevant"] * self.labelled).repartitionByRange(max(1, -(-n_queries // size)), "filter_category", "search_location_id", "uid")
        # Items of a category come together, so that queries pass over the blocks of other ones.
        blocks = items.select(*_ITEM, *carried).repartitionByRange(n_blocks, "item_category_id", F.xxhash64("item_id"))
        of_kind, near = centroids._cut_at, None if asked is None else asked._cut_at
        self.items = cut_lineage(blocks.mapInArrow(lambda batches: _packed(batches, lambda t: _pack(t, of_kind, near, threshold, carried)), "least long, most long, block binary"))

    def run(self, lists: bool = False) -> DataFrame:
        """``uid, query_id, variant, item_id``, the scores, ``location_distance_km``, ``rrf_score`` and ``rrf_rank`` (from 1).
        With ``lists``, one row a query and variant: ``uid, query_id, variant, candidate_item_ids`` (best first)."""
        weightings, top_k, rrf_k, decay, size, uri = self.weightings, self.top_k, self.rrf_k, self.decay, QUERY_BLOCK, self.items._cut_at
        carried, said, labelled, known = self.carried, self.said, self.labelled, self.known

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks = _corpus(uri, decay)
            for batch in batches:
                for start in range(0, batch.num_rows, size):
                    for table in _ranked(batch.slice(start, size).to_pylist(), blocks, weightings, top_k, rrf_k, carried, said, labelled, known):
                        if lists:
                            ids = pa.array([table.column("item_id").to_pylist()], pa.list_(pa.string()))
                            table = table.select(["uid", "query_id", "variant"]).slice(0, 1).append_column("candidate_item_ids", ids)
                        yield from table.to_batches()

        return self.queries.mapInArrow(work, "uid long, query_id string, variant long, candidate_item_ids array<string>" if lists else _RESULT + self.added)
