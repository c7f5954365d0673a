"""Operator 5: near-duplicate documents by MinHash with sequential Bayesian verification.

1. Every text becomes its set of distinct five-word shingles (64-bit hashes), a signature of ``ROWS * BANDS`` minima and
   one key for each band.  Texts with equal sets are one class from here on, so copies are never compared.
2. Classes that share a band key are candidates.  Buckets are cut into blocks of bounded size (classes and shingles).  A
   bucket of one block is compared as a whole (equal member lists of several bands once); of a larger one, each block is
   compared with itself and with the first block.  Links found so far are contracted to components, and only what still
   spans components goes on: all blocks against the blocks that hold members outside the bucket's main component.  No
   bucket is capped and no pair of different components that share a key is left out.
3. Two classes are compared by batches of their signatures: after each batch the pair is dropped if, given the matches
   so far and a uniform prior, the chance that their similarity reaches the threshold is below ``MISS``.  Survivors are
   verified on the full sets.  Links inside a component that is known already are not needed and not verified.
4. Components of the verified links are found by repeated contraction to the least neighbour.

Only spanning links leave a comparison, at most one less than its members.  The links equal the exact join but for the
chosen miss probability (of the bands at the threshold: (1 - 0.85**6)**24 = 1.2e-5; less above it).  Another threshold
has bands of its own (``bands``; 5 x 28 at 0.8, which miss 1.5e-5).

Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; with fewer than five, the whole sequence is one shingle; without
words (null, empty, blank) the set is empty and the row is linked with nothing.  A row without an id stands alone (no
component, kept).  Repeated rows share their class; rows that repeat an id with another text belong to their text's class.
"""
from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, word_hashes, written

#: production parameters
WORDS = 5
PERCENT = 85  # least similarity of a link
ROWS, BANDS = 6, 24  # of PERCENT; bands() has those of other thresholds
BAND_MISS = 2e-5  # chance that a pair at the threshold shares no band
MISS = 1e-6  # chance at which a pair counts as below the threshold
BATCH = 16  # signature values compared at a time
BLOCK = 128  # classes of a block
BLOCK_SHINGLES = 300_000  # of a block

_MULT = np.random.default_rng(20).integers(1, 1 << 62, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_Q = np.uint64(0x9FB21C651E98DF25)


def shingles(texts):
    """Yields (number of shingles of each text with repetitions, hashes of them all) for runs of texts."""
    for _, n, h in word_hashes(texts):
        first = np.append(0, np.cumsum(n))[:-1]
        s = np.zeros(len(h), np.uint64)
        for k in range(WORDS):
            s *= _Q
            s[:max(0, len(h) - k)] += h[k:]
        s = mix(s)
        left = np.repeat(n, n) - (np.arange(len(h)) - np.repeat(first, n))  # words from here to the text's end
        keep = left >= WORDS
        for i in np.flatnonzero((n > 0) & (n < WORDS)):  # the whole sequence, told apart by its length
            x = np.uint64(0)
            for w in h[first[i]:first[i] + n[i]]:
                x = mix(np.array([x], np.uint64) * _Q + w + np.uint64(n[i]))[0]
            s[first[i]], keep[first[i]] = x, True
        yield np.where(n >= WORDS, n - WORDS + 1, np.minimum(n, 1)), s[keep]


def sketch(n: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Minima (texts x hash functions) of texts with n > 0 shingles each."""
    first = np.append(0, np.cumsum(n))[:-1]
    out = np.empty((len(n), ROWS * BANDS), np.uint64)
    buf = np.empty_like(s)
    for k, a in enumerate(_MULT):
        np.multiply(s, a, out=buf)
        out[:, k] = np.minimum.reduceat(buf, first)
    return out


def bands(percent: int = PERCENT) -> tuple[int, int]:
    """(rows, bands) of a threshold: the most rows with which a pair at the threshold is missed at most at ``BAND_MISS``."""
    total = ROWS * BANDS
    for rows in range(total, 1, -1):
        if (1 - (percent / 100) ** rows) ** (total // rows) <= BAND_MISS:
            return rows, total // rows
    return 1, total


def band_keys(minima: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    n_rows, n_bands = bands(percent)
    keys = np.tile(np.arange(n_bands, dtype=np.uint64), (len(minima), 1))
    rows = minima[:, :n_rows * n_bands].reshape(len(minima), n_bands, n_rows)
    for r in range(n_rows):
        keys = mix(keys * _Q + rows[:, :, r])
    return keys


def _digest(unique: np.ndarray) -> bytes:
    return hashlib.blake2b(unique.tobytes(), digest_size=16).digest()


def _sketches(batches, percent: int = PERCENT):
    for b in batches:
        size, digest, keys, sig = [], [], [], []
        for n, s in shingles(b.column("text")):
            cut = np.append(0, np.cumsum(n))
            sets = [np.unique(s[i:j]) for i, j in zip(cut, cut[1:])]
            size += [len(u) for u in sets]
            digest += [_digest(u) if len(u) else None for u in sets]
            some = n > 0
            if some.any():
                m = sketch(n[some], s)
                k = iter(band_keys(m, percent))
                v = iter((m >> np.uint64(30)).astype(np.uint8))
                keys += [next(k).tobytes() if x else None for x in some]
                sig += [next(v).tobytes() if x else None for x in some]
            else:
                keys += [None] * len(n)
                sig += [None] * len(n)
        yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("doc_id"), b.column("text_hash"), pa.array(size, pa.int64()), pa.array(digest, pa.binary()),
                                          pa.array(keys, pa.binary()), pa.array(sig, pa.binary())],
                                         names=["rid", "doc_id", "text_hash", "n_shingles", "digest", "keys", "sig"])


def _explode_keys(batches):
    for b in batches:
        flat = np.frombuffer(b"".join(b.column("keys").to_pylist()), np.int64)
        rows = np.repeat(np.arange(b.num_rows), len(flat) // max(1, b.num_rows))
        yield pa.RecordBatch.from_arrays([pa.array(flat), b.column("cid").take(pa.array(rows)), b.column("n_shingles").take(pa.array(rows))],
                                         names=["key", "cid", "n"])


def _sets(batches):
    """Shingle sets of candidate classes; of several texts under one id, those of the class asked for."""
    for b in batches:
        want, out, at = b.column("digest").to_pylist(), [], []
        i = 0
        for n, s in shingles(b.column("text")):
            cut = np.append(0, np.cumsum(n))
            for x, y in zip(cut, cut[1:]):
                u = np.unique(s[x:y])
                if _digest(u) == want[i]:
                    out.append(u.tobytes())
                    at.append(i)
                i += 1
        yield pa.RecordBatch.from_arrays([b.column("cid").take(pa.array(at, pa.int64())), pa.array(out, pa.binary())], names=["cid", "shingles"])


def least_matches(percent: int = PERCENT, miss: float = MISS, total: int = ROWS * BANDS, batch: int = BATCH) -> list[tuple[int, int]]:
    """(values compared, least matches to stay): with m of n equal and a uniform prior, the chance of a similarity of at
    least t is P(Bin(n + 1, t) <= m); signature values are single bytes, so t counts chance matches, too."""
    t = percent / 100
    t += (1 - t) / 256
    out = []
    for n in range(batch, total + 1, batch):
        chance, m = 0.0, -1
        while chance < miss:
            m += 1
            chance += comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return out


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x


def spanning_links(sig: np.ndarray, sets: list[np.ndarray], left: np.ndarray, comp: np.ndarray, keys: np.ndarray | None = None,
                   band: int = 0, percent: int = PERCENT, rules=None) -> list[tuple[int, int]]:
    """Verified links that span the components among members: pairs with at least one member in ``left`` and of different
    ``comp``; with ``keys``, pairs that share an earlier band's key are left to that band."""
    rules = rules or least_matches(percent)
    size = np.array([len(s) for s in sets])
    forest, links = Forest(len(sets)), []
    chief: dict[int, int] = {}
    for i, c in enumerate(comp.tolist()):
        forest.up[i] = chief.setdefault(c, i)
    place = np.full(len(sets), len(sets))
    place[left] = np.arange(len(left))
    step = max(1, 200_000 // max(1, len(sets)))
    found = []
    for lo in range(0, len(left), step):
        rows = left[lo:lo + step]
        x, y = np.nonzero(np.ones((len(rows), len(sets)), bool))
        x = rows[x]
        ok = (comp[x] != comp[y]) & (place[x] < place[y]) & (100 * np.minimum(size[x], size[y]) >= percent * np.maximum(size[x], size[y]))
        x, y = x[ok], y[ok]
        if keys is not None and band:
            fresh = ~(keys[x, :band] == keys[y, :band]).any(1)
            x, y = x[fresh], y[fresh]
        same, done = np.zeros(len(x), np.int64), 0
        for n, least in rules:
            same += (sig[x, done:n] == sig[y, done:n]).sum(1)
            done = n
            stay = same >= least
            x, y, same = x[stay], y[stay], same[stay]
        found.append((x, y, same))
    if not found:
        return links
    x, y, same = (np.concatenate(c) for c in zip(*found))
    for k in np.argsort(-same, kind="stable").tolist():
        i, j = int(x[k]), int(y[k])
        a, b = forest.root(i), forest.root(j)
        if a != b:
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                forest.up[a] = b
                links.append((i, j))
    return links


def _compare(percent: int):
    rules = least_matches(percent)

    def run(t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.argsort(t.column("cid").to_numpy(), kind="stable")))
        cid = t.column("cid").to_numpy()
        first = np.append(True, cid[1:] != cid[:-1])  # an id's repeated rows bring a set twice
        t, cid = t.filter(pa.array(first)), cid[first]
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(len(cid), -1)
        keys = np.frombuffer(b"".join(t.column("keys").to_pylist()), np.uint64).reshape(len(cid), -1)
        sets = [np.frombuffer(s, np.uint64) for s in t.column("shingles").to_pylist()]
        left = np.flatnonzero(t.column("left").to_numpy(zero_copy_only=False))
        links = spanning_links(sig, sets, left, t.column("comp").to_numpy(), keys, t.column("band")[0].as_py(), percent, rules)
        a, b = np.array(links, np.int64).reshape(-1, 2).T
        return pa.table({"a": cid[a], "b": cid[b]})
    return run


def components(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes of the links; root: one node for each component.  Each round moves every node to its
    least neighbour and keeps the links between different targets, which at least halves the nodes that have links."""
    now = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "dup-links")
    total = None
    while not now.isEmpty():
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        move = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to")), "dup-move")
        if total is None:
            total = move
        else:
            total = written(total.join(move.select(F.col("node").alias("to"), F.col("to").alias("next")), "to", "left")
                            .select("node", F.coalesce("next", "to").alias("to")), "dup-total")
        ends = now.join(move.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(
            move.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        now = written(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct(), "dup-links")
    if total is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    return total.select("node", F.col("to").alias("root"))


def classes_of(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """rid, doc_id, text_hash, n_shingles, component_id of every row; rid: a number of the row."""
    src = docs.select(F.monotonically_increasing_id().alias("rid"), docs[key].cast("long").alias("doc_id"), F.xxhash64(docs[text]).alias("text_hash"),
                      docs[text].alias("text"))
    rows = written(src.mapInArrow(lambda batches: _sketches(batches, percent), "rid long, doc_id long, text_hash long, n_shingles long, digest binary, keys binary, sig binary"), "dup-sketch")
    named = rows.where("digest is not null and doc_id is not null")
    classes = written(named.groupBy("digest").agg(F.min("rid").alias("cid"), F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"),
                                                  F.first("keys").alias("keys"), F.first("sig").alias("sig")), "dup-classes")
    # candidates: band keys that several classes share, cut into blocks of bounded size
    members = classes.select("keys", "cid", "n_shingles").mapInArrow(_explode_keys, "key long, cid long, n long")
    shared = members.groupBy("key").agg(F.count("*").alias("size"), F.sum("n").alias("n")).where("size > 1")
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("n") / BLOCK_SHINGLES)).cast("int")
    shared = written(shared.select("key", blocks.alias("blocks")), "dup-shared")
    held = written(members.select("key", "cid").join(shared, "key").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")), "dup-members")
    # their sets, from one more pass over the text
    asked = classes.join(held.select("cid").distinct(), "cid", "left_semi").select("cid", F.col("rep").alias("doc_id"), "digest")
    texts = src.select("doc_id", "text").join(asked, "doc_id")
    once = texts.groupBy("doc_id", "cid", "digest", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"))
    sets = once.select("cid", "digest", "text").mapInArrow(_sets, "cid long, shingles binary")
    data = written(sets.join(classes.select("cid", "keys", "sig"), "cid"), "dup-data")

    compared = "item binary, cid long, band int, left boolean, comp long"
    links_of = lambda items: (items.join(data, "cid").groupBy("item").applyInArrow(_compare(percent), "a long, b long"))
    small = (held.where("blocks = 1").groupBy("key").agg(F.sort_array(F.collect_list("cid")).alias("cids")).select("cids").distinct()
             .select(F.unhex(F.md5(F.concat_ws(",", F.col("cids").cast("array<string>")))).alias("item"), F.explode("cids").alias("cid")))
    small = small.select("item", "cid", F.lit(0).alias("band"), F.lit(True).alias("left"), F.col("cid").alias("comp"))
    item = lambda *c: F.unhex(F.md5(F.concat_ws(",", *[F.col(x).cast("string") if isinstance(x, str) else x.cast("string") for x in c])))
    large = held.where("blocks > 1")
    # each block with itself and with the first: the members of the first go to every item of their bucket
    other = F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    star = large.select("key", "cid", F.explode(other).alias("o")).select(
        item("key", "o").alias("item"), "cid", F.lit(0).alias("band"), F.lit(True).alias("left"), F.col("cid").alias("comp"))
    links = written(links_of(small.unionByName(star)), "dup-found")
    comp = written(components(links), "dup-comp")
    # larger buckets that still span components: every block against those with members outside the main component
    spread = written(large.join(comp.select(F.col("node").alias("cid"), "root"), "cid", "left")
                     .select("key", "cid", "block", "blocks", F.coalesce("root", "cid").alias("comp")), "dup-spread")
    sizes = spread.groupBy("key", "comp").agg(F.count("*").alias("size"))
    main = sizes.groupBy("key").agg(F.max(F.struct("size", "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1")
    main = written(main.select("key", F.col("top.comp").alias("main")), "dup-main")
    open_ = spread.join(main, "key").withColumn("left", F.col("comp") != F.col("main"))
    band = bands_at(data)
    rest = written(open_.join(band, ["cid", "key"]).select("key", "cid", "block", "blocks", "comp", "left", "band"), "dup-rest")
    # item (i, j): outsiders of block i against all of block j > i and outsiders of j against block i; (i, i) once
    pairs = rest.select("key", "cid", "band", "left", "comp", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    pairs = pairs.select(item("key", F.least("block", "o"), F.greatest("block", "o"), F.lit("r")).alias("item"), "cid", "band", "left", "comp")
    again = written(links.unionByName(links_of(pairs)), "dup-all")
    total = written(components(again), "dup-components")
    named_class = classes.select("cid", "digest", "rep").join(total.select(F.col("node").alias("cid"), "root"), "cid", "left")
    named_class = named_class.withColumn("root", F.coalesce("root", "cid"))
    least = named_class.groupBy("root").agg(F.min("rep").alias("component_id"))
    known = written(named_class.join(least, "root").select("digest", "component_id"), "dup-known")
    out = rows.select("rid", "doc_id", "text_hash", "n_shingles", "digest").join(known, "digest", "left")
    return out.select("rid", "doc_id", "text_hash", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def bands_at(data: DataFrame) -> DataFrame:
    """cid, key, band of all candidates."""
    def run(batches):
        for b in batches:
            flat = np.frombuffer(b"".join(b.column("keys").to_pylist()), np.int64)
            n = len(flat) // max(1, b.num_rows)
            rows = pa.array(np.repeat(np.arange(b.num_rows), n))
            yield pa.RecordBatch.from_arrays([b.column("cid").take(rows), pa.array(flat), pa.array(np.tile(np.arange(n, dtype=np.int32), b.num_rows))],
                                             names=["cid", "key", "band"])
    return data.select("cid", "keys").mapInArrow(run, "cid long, key long, band int")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    c = classes_of(docs, key, text, percent)
    return c.select(F.col("doc_id").alias(key), "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without all but one of each group of near duplicates: the row whose id names the component,
    once if id and text are repeated."""
    c = classes_of(docs, key, text, percent).where("doc_id = component_id")
    stays = c.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    packed = docs.select(F.struct(*[docs[x] for x in docs.columns]).alias("row"))
    packed = packed.where(F.col(f"row.{key}").isNotNull()).select("row", F.col(f"row.{key}").cast("long").alias("_id"), F.xxhash64(f"row.{text}").alias("_hash"))
    turn = Window.partitionBy("_id", "_hash").orderBy("_id")
    kept = packed.join(stays, ["_id", "_hash"]).withColumn("_turn", F.row_number().over(turn)).where("_turn = 1").select("row.*")
    return kept.unionByName(docs.where(docs[key].isNull()))
