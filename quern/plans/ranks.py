"""Running sums and ranks inside groups of any size: no group, and no value, is held by one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.plans.lineage import cut_lineage


def _local(groups: list[str], weight: str):
    """Each row's running sum within its group, as far as this task sees it; the input is sorted by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the last row seen: whether its group goes on is known with the next one
        last: tuple | None = None
        carry, initial, opened = 0, True, False

        def done(table: pa.Table, sums: np.ndarray, inside: np.ndarray, opens: np.ndarray, closes: np.ndarray, edge: np.ndarray) -> Iterator[pa.RecordBatch]:
            out = table.append_column("_before", pa.array(sums)).append_column("_initial", pa.array(inside)).append_column("_single", pa.array(opens & closes)).append_column("_edge", pa.array(edge))
            yield from out.combine_chunks().to_batches()

        extra: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            size = table.num_rows
            change = np.zeros(size, bool)
            for g in groups:
                codes = table.column(g).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
                change[1:] |= codes[1:] != codes[:-1]
            row = tuple(table.column(g)[0].as_py() for g in groups)
            start = last is None
            change[0] = start or row != last
            w = table.column(weight).to_numpy()
            sums = np.cumsum(w) - w
            begin = np.maximum.accumulate(np.where(change, np.arange(size), -1))
            before = np.where(begin >= 0, sums - sums[np.maximum(begin, 0)], sums + carry)
            inside = np.full(size, initial)
            later = np.flatnonzero(change)
            later = later[1:] if start else later
            if len(later):
                inside[later[0] :] = False
            edge = np.zeros(size, "int32")
            edge[0] = int(start)
            if held is not None:
                s, i, o, e = extra
                yield from done(held, s, i, o, change[:1], e)
            closes = np.append(change[1:], False)
            if size > 1:
                yield from done(table.slice(0, size - 1), before[:-1], inside[:-1], change[:-1], closes[:-1], edge[:-1])
            held, extra = table.slice(size - 1), (before[-1:], inside[-1:], change[-1:], edge[-1:])
            last, carry, initial = tuple(table.column(g)[size - 1].as_py() for g in groups), int(before[-1] + w[-1]), bool(inside[-1])
        if held is not None:
            s, i, o, e = extra
            yield from done(held, s, i, o, np.ones(1, bool), e + 2)

    return run


def running_sums(df: DataFrame, groups: list[str], order: list[Column], weight: str, name: str = "before") -> DataFrame:
    """Adds ``name``, the sum of integer ``weight`` over the rows of the same group before the row, and ``alone``, whether the
    row is its group's only one.

    Rows are range-partitioned and sorted by group and order, and summed inside each partition; only groups that cross
    partitions need the sums before them, so two rows a partition suffice to complete all. ``order`` has no ties in a group.
    """
    keys = [*(F.col(g).asc_nulls_last() for g in groups), *order]
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    kinds = ", ".join(f"`{n}` {k}" for n, k in ordered.dtypes)
    local = ordered.mapInArrow(_local(groups, weight), f"{kinds}, _before long, _initial boolean, _single boolean, _edge int")
    placed = cut_lineage(local.withColumn("_part", F.spark_partition_id()))
    edges = placed.where("_edge > 0").select("_part", "_edge", "_initial", (F.col("_before") + F.col(weight)).alias("sum"), *(F.col(g).alias(f"g{i}") for i, g in enumerate(groups))).collect()
    rows, held, total = [], None, 0
    first = {r["_part"]: r for r in edges if r["_edge"] & 1}
    final = {r["_part"]: r for r in edges if r["_edge"] & 2}
    key = lambda r: tuple(r[f"g{i}"] for i in range(len(groups)))
    joins = {}
    for part in sorted(first):
        begin, end = first[part], final[part]
        goes_on = held is not None and key(begin) == held
        joins[part] = goes_on
        offset = total if goes_on else 0
        held, total = key(end), end["sum"] + (offset if end["_initial"] else 0)
        rows.append([part, offset, goes_on, False])
    for a, b in zip(rows, rows[1:]):
        a[3] = b[2]
    table = df.sparkSession.createDataFrame([tuple(r) for r in rows], "_part int, _offset long, _joins boolean, _leaves boolean")
    out = placed.join(F.broadcast(table), "_part")
    before = F.col("_before") + F.when(F.col("_initial"), F.col("_offset")).otherwise(0)
    alone = F.col("_single") & ~(F.col("_initial") & F.col("_joins")) & ~((F.col("_edge") >= 2) & F.col("_leaves"))
    return out.select(*df.columns, before.alias(name), alone.alias("alone"))


def average_ranks(df: DataFrame, groups: list[str], value: str, descending: bool = True) -> DataFrame:
    """``groups, value, n, rank, alone`` for each distinct value: rows with equal values share the mean of their ranks.

    Computed on counts by value, so rows are combined map-side.
    """
    counts = df.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n"))
    order = F.col(value).desc() if descending else F.col(value).asc()
    return running_sums(counts, groups, [order], "n").withColumn("rank", F.col("before") + (F.col("n") + 1) / 2.0).drop("before")


def quantiles(df: DataFrame, group: str, value: str, shares: list[float]) -> DataFrame:
    """``group, share, quantile``: exact quantiles of double ``value`` (no nulls), interpolated between neighbours."""
    placed = running_sums(df.groupBy(group, value).agg(F.count(F.lit(1)).alias("n")), [group], [F.col(value).asc()], "n").drop("alone")
    totals = df.groupBy(group).agg(F.count(F.lit(1)).alias("total"))
    asked = totals.withColumn("share", F.explode(F.array(*(F.lit(float(s)) for s in shares)))).withColumn("at", F.col("share") * (F.col("total") - 1))
    asked = asked.select(F.col(group).alias("_g"), "share", "at", F.floor("at").alias("low"), F.ceil("at").alias("high"))
    holds = lambda c: (F.col("before") <= F.col(c)) & (F.col(c) < F.col("before") + F.col("n"))
    met = placed.join(F.broadcast(asked), F.col(group).eqNullSafe(F.col("_g"))).where(holds("low") | holds("high"))
    ends = met.groupBy(group, "share", "at", "low").agg(F.min(value).alias("a"), F.max(value).alias("b"))
    return ends.select(group, "share", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.col("low"))).alias("quantile"))
