"""Operator 12: sharding by minimax contiguous partition.

Documents with equal texts form an atomic group; groups are ordered by their text's digest, which spreads neighbours of
the corpus, and the order is cut into contiguous shards.  Binary search finds the smallest capacity at which greedy
filling needs no more than the permitted shards.  A greedy check only asks, for some sum, which group holds it; so the
search runs on a histogram by digest prefix, every cell that a question falls into is opened into longer prefixes by
Spark, and the search is run again until no question falls into an unopened cell.  Then every answer was the one that
the full list of groups would give, and neither the driver nor a task holds that list: a round brings at most 65,536
cells, or 256 for each question.

Cut at that capacity, greedy filling would leave the last shards empty when one group is huge.  So the cuts are laid
at the group boundary nearest to a fair share of what remains, within the bounds that the capacity leaves (the latest
from greedy filling forwards, the earliest from the end backwards).  No shard passes the smallest capacity; all are near
equal where groups permit it.

Size: UTF-8 bytes of the text and 1; a null text counts as empty and is in the group of the empty text.  Rows of a group
are placed by id (nulls last), repeated rows by their place in the table.  With fewer groups than shards some shards are
empty.  An empty table gives no row.  Other columns, whatever their names, are not read.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .sorted_ranks import ranked, sorted_runs

#: production parameters
SHARDS = 16
LAW = "bytes"

FIRST = 4  # hex digits of the first histogram
MORE = 2  # digits by which a cell is opened


class Partition:
    """Capacity and cuts over ordered cells; ``asked`` gathers the unopened cells that a question fell into."""

    def __init__(self, sums: np.ndarray, atomic: np.ndarray, shards: int):
        self.cum = np.append(0, np.cumsum(sums))
        self.atomic, self.shards, self.asked = atomic, shards, set()

    def _within(self, cell: int) -> None:
        if not self.atomic[cell]:
            self.asked.add(cell)

    def upto(self, x: int) -> int:
        """The last boundary at or before ``x`` bytes."""
        i = int(np.searchsorted(self.cum, x, "right")) - 1
        if i < len(self.atomic) and self.cum[i] < x:
            self._within(i)
        return i

    def since(self, x: int) -> int:
        """The first boundary at or after ``x`` bytes."""
        i = int(np.searchsorted(self.cum, x, "left"))
        if i > 0 and self.cum[i] > x:
            self._within(i - 1)
        return i

    def fits(self, capacity: int) -> bool:
        """Greedy check."""
        at, n = 0, len(self.atomic)
        for _ in range(self.shards):
            at = self.upto(int(self.cum[at]) + capacity)
            if at == n:
                return True
        return False

    def capacity(self, largest: int) -> int:
        """The smallest feasible one; ``largest`` is the size of the largest group."""
        fair = -(-int(self.cum[-1]) // self.shards)
        low, high = max(largest, fair), fair + largest  # the latter always fits
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.fits(mid) else (mid + 1, high)
        return low

    def cuts(self, capacity: int) -> list[int]:
        """First cell of each shard but the first."""
        n, cum = len(self.atomic), self.cum
        earliest = [n]  # from where the rest fits into 0, 1, 2, ... shards
        for _ in range(self.shards - 1):
            earliest.append(self.since(max(0, int(cum[earliest[-1]]) - capacity)))
        at, out = 0, []
        for left in range(self.shards - 1, 0, -1):  # shards after this one
            if at < n:
                fair = int(cum[at]) + (int(cum[-1]) - int(cum[at])) // (left + 1)
                to = self.upto(fair)
                if to < n and cum[to + 1] - fair < fair - cum[to]:
                    to += 1
                if to <= at:
                    self._within(at)
                    to = at + 1
                if to > n - left:  # a group for each shard to come
                    for cell in range(max(at, n - left), n):
                        self._within(cell)
                    to = max(at + 1, n - left)
                at = min(max(to, earliest[left]), max(self.upto(int(cum[at]) + capacity), at + 1))
            out.append(at)
        return out


def cut_points(groups: DataFrame, shards: int = SHARDS) -> tuple[int, list[str]]:
    """The smallest capacity, and the digest prefix at which each shard but the first begins.  ``groups``: one row a
    group with digest (hex) and bytes."""
    cell = lambda d: F.substring("digest", 1, d).alias("cell")
    of = lambda df: df.agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"), F.max("bytes").alias("largest")).collect()
    cells = {r["cell"]: (r["bytes"], r["n"], r["largest"]) for r in of(groups.groupBy(cell(FIRST)))}
    largest = max((c[2] for c in cells.values()), default=0)
    while True:
        names = sorted(cells)
        found = Partition(np.array([cells[c][0] for c in names], np.int64), np.array([cells[c][1] == 1 for c in names], bool), shards)
        capacity = found.capacity(largest)
        cuts = found.cuts(capacity)
        opened = [names[i] for i in found.asked]
        if not opened:
            return capacity, [names[i] if i < len(names) else "~" for i in cuts]
        longer = F.lit(None).cast("string")
        for d in sorted({len(c) for c in opened}):
            longer = F.when(F.substring("digest", 1, d).isin([c for c in opened if len(c) == d]), F.substring("digest", 1, d + MORE)).otherwise(longer)
        for c in opened:
            del cells[c]
        inside = groups.select(longer.alias("cell"), "bytes").where("cell is not null").groupBy("cell")
        cells |= {r["cell"]: (r["bytes"], r["n"], r["largest"]) for r in of(inside)}


def shard_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """``key``, size, text_crc32, law, shard, slot, grown_shard (null under this law) of every row."""
    src = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = src.schema["key"].dataType
    rows = src.select("key", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
                      F.substring(F.sha2("text", 256), 1, 32).alias("digest"), F.col("key").isNull().cast("int").alias("no_key"),
                      F.coalesce("key", F.lit(0).cast(kind)).alias("id"))
    order = ["digest", "no_key", "id"]
    runs = sorted_runs(rows, order, "shard")
    # partial sums first: a group that holds a third of all rows is one row a task
    groups = written(runs.groupBy("digest").agg(F.sum("size").alias("bytes")), "shard-groups")
    _, cuts = cut_points(groups, shards)
    shard = sum(((F.col("digest") >= c).cast("int") for c in cuts), F.lit(0))
    placed = ranked(runs, order, "shard").withColumn("shard", shard)
    firsts = {r["shard"]: r["first"] for r in placed.groupBy("shard").agg(F.min("rank").alias("first")).collect()}  # one row a shard
    first = F.element_at(F.array(*(F.lit(firsts.get(k, 1)).cast("long") for k in range(shards))), F.col("shard") + 1)
    return placed.select(F.col("key").alias(key), "size", "text_crc32", F.lit(LAW).alias("law"), "shard",
                         (F.col("rank") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
