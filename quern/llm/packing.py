"""Filling fixed-capacity containers: large-item matching, then best fit.

A pack holds at most two texts above a third of its capacity. Those are matched first: the largest takes the largest
partner that still fits, and large texts without a partner open a pack of their own. All smaller texts then go, largest
first, into the pack with the least sufficient room, and open a new pack only if none has it. A text longer than the
capacity is cut into full packs and one rest, which is packed like any other text.

The work is divided into blocks of texts, each of thousands of packs; every block closes its packs by itself, so that only
a block's last few packs can stay partly empty.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.plans.lineage import cut_lineage

#: Packs that a block should fill, on average.
BLOCK_PACKS = 4000


def pack_block(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Pack numbers (from 0) of items of 1..capacity, and how many packs there are."""
    order = np.argsort(-sizes, kind="stable")
    pack = np.full(len(sizes), -1)
    room: list[int] = []
    large = [int(k) for k in order if 3 * sizes[k] > capacity]
    # Partners are taken from a list kept by size; equal sizes in input order.
    waiting = sorted((int(sizes[k]), -n) for n, k in enumerate(large))
    for n, k in enumerate(large):
        if pack[k] >= 0:
            continue
        at = bisect_right(waiting, (int(sizes[k]), -n)) - 1
        waiting.pop(at)
        pack[k] = len(room)
        left = capacity - int(sizes[k])
        fits = bisect_right(waiting, (left, 1)) - 1
        if fits >= 0:
            size, other = waiting.pop(fits)
            pack[large[-other]] = len(room)
            left -= size
        room.append(left)
    # Packs by their room; a big integer marks the rooms that some pack has.
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    marks = 0
    for p in range(len(room) - 1, -1, -1):
        by_room[room[p]].append(p)
        marks |= 1 << room[p]
    for k in order[len(large) :]:
        size = int(sizes[k])
        above = marks >> size
        if above:
            r = size + (above & -above).bit_length() - 1
            p = by_room[r].pop()
            if not by_room[r]:
                marks ^= 1 << r
        else:
            r, p = capacity, len(room)
            room.append(capacity)
        pack[k] = p
        room[p] = r - size
        by_room[room[p]].append(p)
        marks |= 1 << room[p]
    return pack, len(room)


def pack_items(items: DataFrame, capacities: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens", block_packs: int = BLOCK_PACKS) -> DataFrame:
    """Packs ``items`` (id, size) for every row of ``capacities`` (pack_name, capacity_tokens).

    Returns ``pack_name, block, pack, <id>, first_token, n_tokens``: one row per piece; only an item above the capacity
    has more than one. (pack_name, block, pack) is one container. Items of size 0 or null need no room: they come out once
    with a null pack. Capacities that are null or below 1 are left out; empty tables give no rows. Repeated ids are packed
    as separate items. The same items give the same packs.
    """
    sizes = [(r["pack_name"], int(r["capacity_tokens"])) for r in capacities.collect() if r["capacity_tokens"] and r["capacity_tokens"] > 0]
    base = cut_lineage(items.select(F.col(id_col).alias("id"), F.coalesce(F.col(size_col).cast("long"), F.lit(0).cast("long")).alias("size")))
    total = base.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    if not sizes:
        base, sizes = base.limit(0), [("", 1)]
    # At least 3 blocks a capacity where that many packs exist; more as the corpus grows.
    plan = [(name, c, max(1, min(total // (c * 200), max(3, total // (c * block_packs))))) for name, c in sizes]
    offered = F.explode(F.array(*(F.struct(F.lit(n).alias("pack_name"), F.lit(c).cast("long").alias("capacity"), F.lit(b).cast("long").alias("blocks")) for n, c, b in plan)))
    rows = base.withColumn("p", offered).select("id", "size", "p.pack_name", "p.capacity", F.pmod(F.xxhash64("id", "size"), F.col("p.blocks")).alias("block"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        capacity = int(pdf["capacity"].iloc[0])
        pdf = pdf.sort_values(["id", "size"], kind="stable")
        size = pdf["size"].to_numpy()
        whole = size // capacity
        rest = size - whole * capacity
        # Full packs first, then the rests.
        src = np.concatenate([np.repeat(np.arange(len(size)), whole), np.flatnonzero(rest), np.flatnonzero(size == 0)])
        n_full, n_rest = int(whole.sum()), int((rest > 0).sum())
        start = np.concatenate([[0], np.cumsum(whole)[:-1]]) if len(whole) else np.zeros(0)
        nth = np.arange(n_full) - np.repeat(start, whole)
        first = np.concatenate([nth * capacity, (whole * capacity)[rest > 0], np.zeros(int((size == 0).sum()))]).astype("int64")
        pieces = np.concatenate([np.full(n_full, capacity), rest[rest > 0], np.zeros(int((size == 0).sum()))]).astype("int64")
        packed, _ = pack_block(rest[rest > 0], capacity)
        pack = np.concatenate([np.arange(n_full), packed + n_full, np.full(int((size == 0).sum()), -1)]).astype("int64")
        out = pdf.iloc[src]
        numbers = pd.arrays.IntegerArray(np.maximum(pack, 0), pack < 0)
        return pd.DataFrame({"pack_name": out["pack_name"].to_numpy(), "block": out["block"].to_numpy(), "pack": numbers, "id": out["id"].to_numpy(), "first_token": first, "n_tokens": pieces})

    kind = dict(base.dtypes)["id"]
    done = rows.groupBy("pack_name", "block").applyInPandas(fill, f"pack_name string, block long, pack long, id {kind}, first_token long, n_tokens long")
    return done.select("pack_name", "block", "pack", F.col("id").alias(id_col), "first_token", "n_tokens")


def fill_report(packs: DataFrame, capacities: DataFrame) -> DataFrame:
    """Per capacity: number of packs and items, tokens, and the share of room that is filled."""
    used = packs.where("pack IS NOT NULL").groupBy("pack_name", "block", "pack").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    used = used.groupBy("pack_name").agg(F.count(F.lit(1)).alias("n_packs"), F.sum("n").alias("n_pieces"), F.sum("t").alias("n_tokens"))
    return used.join(capacities.select("pack_name", "capacity_tokens"), "pack_name").select("*", F.round(F.col("n_tokens") / (F.col("n_packs") * F.col("capacity_tokens")), 6).alias("filled"))
