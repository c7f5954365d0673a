"""Operator 8: variable-capacity best-fit packing of texts into training sequences.

Lengths are words ``[^\\x20\\x09-\\x0D]+`` plus one end mark; a text beyond the largest capacity becomes pieces of that
capacity and a rest, so nothing is dropped.  Pieces are dealt by hash into shards of bounded size, and each shard is
packed for itself: longest piece first, into the open bin with the least room that holds it.  When none does, a bin is
opened in the permitted size of least expected cost per token: its cost (tokens plus a fixed price per sequence) over
what it will carry, which is the piece and as much of the room left as unplaced pieces can still fill.  At the end each
bin shrinks to the smallest permitted size that holds its contents.

Null, empty and wordless texts have length 1.  Repeated rows are packed each for itself.  Ties: bins by number of
opening, sizes by the smaller, pieces by row and piece number.
"""
from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, written

#: production parameters
SIZES = (512, 1024, 2048, 4096, 8192)
PRICE = 16  # of a sequence, in tokens
SHARD = 20_000  # pieces packed together; bounds a task


def best_fit(lengths: np.ndarray, sizes=SIZES, price: int = PRICE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pieces sorted by falling length: bin and offset of each piece, final size of each bin."""
    n = len(lengths)
    after = np.append(np.cumsum(lengths[::-1])[::-1], 0)  # tokens of the pieces from i on
    falling = -lengths
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    used: list[int] = []
    room: list[tuple[int, int]] = []  # (room left, bin), sorted
    open_room = 0
    for i, size in enumerate(lengths.tolist()):
        k = bisect_left(room, (size, -1))
        if k < len(room):
            left, b = room.pop(k)
            open_room -= size
        else:
            best = None
            for s in sizes:
                if s < size:
                    continue
                # unplaced pieces that the room left could hold, less the room that stands open already
                fill = after[max(i + 1, int(np.searchsorted(falling, size - s)))] - open_room
                cost = (s + price) / (size + min(s - size, max(0, fill)))
                if best is None or cost < best[0] - 1e-12:
                    best = (cost, s)
            left, b = best[1], len(used)
            used.append(0)
            open_room += left - size
        bins[i], offsets[i] = b, used[b]
        used[b] += size
        if left > size:
            insort(room, (left - size, b))
    small = np.asarray(sorted(sizes))
    return bins, offsets, small[np.searchsorted(small, np.asarray(used, np.int64))] if used else np.zeros(0, np.int64)


def _pack(sizes, price):
    def pack(t: pa.Table) -> pa.Table:
        n, rid, piece = (t.column(c).to_numpy() for c in ("n_tokens", "rid", "piece"))
        order = np.lexsort((piece, rid, -n))
        bins, offsets, size = best_fit(n[order], sizes, price)
        t = t.take(pa.array(order))
        shard = t.column("shard").to_numpy().astype(np.int64)
        return pa.table({**{c: t.column(c) for c in ("rid", "piece", "n_tokens")}, "bin_id": (shard << 32) + bins, "bin_size": size[bins], "bin_offset": offsets})
    return pack


def pack_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", sizes=SIZES, price: int = PRICE, shard: int = SHARD) -> DataFrame:
    """One row per piece: ``key``, piece (from 0), first_token, n_tokens, bin_id, bin_size, bin_offset."""
    sizes, top = tuple(sorted(sizes)), max(sizes)
    words = F.size(F.array_remove(F.split(F.translate(F.coalesce(docs[text], F.lit("")), SPACES, " " * len(SPACES)), " "), ""))
    rows = written(docs.select(F.monotonically_increasing_id().alias("rid"), docs[key].alias("key"), (words + 1).cast("long").alias("n")), "pack-lengths")
    total = rows.agg(F.sum(F.ceil(F.col("n") / top))).collect()[0][0] or 0
    shards = max(1, -(-total // shard))
    pieces = rows.select("rid", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"cast((n - 1) div {top} as bigint)"))).alias("piece"))
    pieces = pieces.select("rid", "piece", F.least(F.lit(top).cast("long"), F.col("n") - F.col("piece") * top).alias("n_tokens"),
                           F.pmod(F.xxhash64("rid", "piece"), F.lit(shards)).cast("int").alias("shard"))
    packed = pieces.groupBy("shard").applyInArrow(
        _pack(sizes, price), "rid long, piece long, n_tokens long, bin_id long, bin_size long, bin_offset long")
    return packed.join(rows.select("rid", "key"), "rid").select(
        F.col("key").alias(key), "piece", (F.col("piece") * top).alias("first_token"), "n_tokens", "bin_id", "bin_size", "bin_offset")
