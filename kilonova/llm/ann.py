"""Operator 6: nearest neighbours by randomly rotated one-bit codes.

Every vector, less a centre and divided by its length, is turned by a random rotation; the signs of the result are its
code (one bit a dimension), next to two scalars: the length and the inner product of the unit vector with its own code.
For a query the inner product with each unit vector is estimated from the packed bits and corrected by that scalar; the
estimate's error is below ``margin`` / sqrt(d - 1) * sqrt(1 - f**2) / f times the query's length with high probability.
So each distance has a lower and an upper bound: vectors whose lower bound is above the k-th smallest upper bound are
out, all others are measured on the original vectors in double precision.  A bound that isn't finite (lengths whose squares
overflow) shuts nothing out, and such a distance is measured again with the largest difference taken out of the root.

Vectors are dealt by hash into shards of bounded size, queries go to every shard in batches (a stated query set against
all rows, in blocks), and each shard returns its k nearest; the k nearest of those are the result.  The centre (medians,
so a few huge vectors don't drag it) comes from a sample of bounded size and only sharpens the codes; every row is indexed.

Rows with a null id, and vectors that are null, empty, zero or hold null or non-finite components take no part.
Vectors of different dimensions aren't compared.  A repeated query id asks once (with its smallest vector); repeated
rows are candidates each for itself; a query's own id is never its neighbour.  Ties go to the smaller id.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: production parameters
MARGIN = 3.0  # error bound in standard deviations of the estimate
SHARD = 65_536  # vectors indexed together; bounds a task
SPREAD = 4_096  # vectors below which a shard isn't split for the sake of more tasks
CENTRE_SAMPLE = 20_000

_ROTATIONS: dict[int, np.ndarray] = {}


def rotation(d: int) -> np.ndarray:
    """A random rotation of d dimensions, the same in every process."""
    if d not in _ROTATIONS:
        q, r = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))
        _ROTATIONS[d] = q * np.sign(np.diag(r))
    return _ROTATIONS[d]


def usable(vec: str) -> Column:
    return F.expr(f"{vec} is not null and size({vec}) > 0 and exists({vec}, x -> x <> 0) and "
                  f"forall({vec}, x -> x is not null and not isnan(x) and abs(x) < cast('Infinity' as double))")


def distances(vectors: np.ndarray, q: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        diff = vectors - q
        dist = np.sqrt((diff * diff).sum(1))
        odd = ~np.isfinite(dist) | (dist < 1e-150)   # squares overflow or vanish
        if odd.any():
            most = np.abs(diff[odd]).max(1)
            part = diff[odd] / np.where(most > 0, most, 1)[:, None]
            dist[odd] = np.where(np.isfinite(most), most * np.sqrt((part * part).sum(1)), np.inf)
    return dist


class Codes:
    """One shard's vectors of one dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, centre: np.ndarray, margin: float = MARGIN):
        self.ids, self.vectors, self.centre = ids, vectors, centre
        d = vectors.shape[1]
        with np.errstate(over="ignore", invalid="ignore"):
            rest = vectors - centre
            self.length = np.sqrt((rest * rest).sum(1))
            turned = np.nan_to_num((rest / np.where(self.length > 0, self.length, 1)[:, None]) @ rotation(d).T)
        self.bits = np.packbits(turned > 0, axis=1)
        self.fit = np.maximum(np.abs(turned).sum(1) / np.sqrt(d), 1e-6)
        self.error = margin * np.sqrt(np.maximum(0, 1 - self.fit ** 2)) / self.fit / np.sqrt(max(1, d - 1))

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances, from below and above: (queries x vectors); -inf and inf where nothing finite is known."""
        d = queries.shape[1]
        with np.errstate(over="ignore", invalid="ignore"):
            q = queries - self.centre
            size = np.sqrt((q * q).sum(1))[:, None]
            # of unit length before it becomes a float: no query is too long for one
            turned = np.nan_to_num((q / np.where(size > 0, size, 1)) @ rotation(d).T).astype(np.float32)
            signs = np.unpackbits(self.bits, axis=1, count=d).astype(np.float32)
            dot = (2 * (turned @ signs.T) - turned.sum(1)[:, None]) / np.float32(np.sqrt(d))  # with the codes
            near = (size ** 2 + self.length ** 2) - 2 * self.length * size * (dot / self.fit)
            slack = 2 * self.length * self.error * size + 1e-5 * (size ** 2 + self.length ** 2)
            low, high = near - slack, near + slack
        known = np.isfinite(low) & np.isfinite(high)
        return np.where(known, low, -np.inf), np.where(known, high, np.inf)

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        """(query, id, distance) of the k nearest vectors of the shard for each query."""
        step = max(1, (8 << 20) // len(self.ids))
        for lo in range(0, len(queries), step):
            low, high = self.bounds(queries[lo:lo + step])
            for qid, q, a, b in zip(query_ids[lo:lo + step], queries[lo:lo + step], low, high):
                b = np.where(self.ids == qid, np.inf, b)
                limit = np.partition(b, k - 1)[k - 1] if len(b) > k else np.inf
                at = np.flatnonzero((a <= limit) & (self.ids != qid))
                dist = distances(self.vectors[at], q)
                best = np.lexsort((self.ids[at], dist))[:k]
                yield np.full(len(best), qid), self.ids[at][best], dist[best]


def _search(k: int, centres: dict[int, list[float]], margin: float):
    def by_dim(ids, vecs):
        size = np.fromiter(map(len, vecs), np.int64, len(vecs))
        for d in np.unique(size):
            at = np.flatnonzero(size == d)
            yield int(d), ids[at], np.stack([vecs[i] for i in at]).astype(np.float64)

    def run(batches):
        shard, held, codes = None, {}, None
        for b in batches:
            shards, kinds, ids = (b.column(c).to_numpy() for c in ("shard", "kind", "vec_id"))
            vecs = b.column("vec").to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(np.diff(shards) | np.diff(kinds)) + 1
            for lo, hi in zip([0, *cut], [*cut, len(shards)]):
                if lo == hi:
                    continue
                if shards[lo] != shard:
                    shard, held, codes = shards[lo], {}, None
                if kinds[lo] == 0:
                    for d, i, v in by_dim(ids[lo:hi], vecs[lo:hi]):
                        held.setdefault(d, []).append((i, v))
                    continue
                if codes is None:
                    codes = {d: Codes(np.concatenate([i for i, _ in x]), np.concatenate([v for _, v in x]),
                                      np.asarray(centres.get(d, np.zeros(d))), margin) for d, x in held.items()}
                    held = {}
                for d, i, v in by_dim(ids[lo:hi], vecs[lo:hi]):
                    if d in codes:
                        got = list(codes[d].nearest(i, v, k))
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*got)], names=["query_id", "vec_id", "score"])
    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vec: str = "embedding", margin: float = MARGIN) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance) of each query's k nearest rows of ``vectors``."""
    spark = vectors.sparkSession
    typed = lambda df: df.select(F.col(key).cast("long").alias("vec_id"), F.col(vec).cast("array<double>").alias("vec")).where(
        F.col("vec_id").isNotNull() & usable("vec"))
    data, asked = typed(vectors), typed(queries).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    n = data.count()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, -(-n // SHARD), min(tasks, -(-n // SPREAD)))
    share = min(1.0, CENTRE_SAMPLE / max(1, n))
    sample = data.where(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 24)) < int(share * (1 << 24)) + 1).limit(2 * CENTRE_SAMPLE)
    means = sample.select(F.size("vec").alias("d"), F.posexplode("vec")).groupBy("d", "pos").agg(F.median("col").alias("m")).orderBy("d", "pos").collect()
    centres: dict[int, list[float]] = {}
    for r in means:
        centres.setdefault(r.d, []).append(r.m)
    rows = data.select(F.pmod(F.xxhash64("vec_id", "vec"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "vec_id", "vec")
    asks = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "vec_id", "vec")
    both = rows.unionByName(asks).repartition(shards, "shard").sortWithinPartitions("shard", "kind")
    found = both.mapInArrow(_search(k, centres, margin), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
