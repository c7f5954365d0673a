import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np

from kilonova.llm import queries, sharding
from kilonova.llm.sharding import Partition, cut_points, shard_documents


def least(sizes, shards):
    """Smallest largest shard over all contiguous partitions, by dynamic programming."""
    cum = np.append(0, np.cumsum(sizes))
    best = cum.astype(float)
    for _ in range(shards - 1):
        best = np.array([min(max(best[j], cum[i] - cum[j]) for j in range(i + 1)) for i in range(len(cum))])
    return int(best[-1])


def groups_of(docs):
    out = defaultdict(list)
    for i, t in docs:
        out[hashlib.sha256((t or "").encode()).hexdigest()[:32]].append((i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())))
    return {d: sorted(r) for d, r in sorted(out.items())}


def check(rows, docs, shards=16):
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in rows) == sorted(x for g in groups_of(docs).values() for x in g)
    groups = groups_of(docs)
    sizes = [sum(x[2] for x in g) for g in groups.values()]
    by = defaultdict(list)
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        by[r.shard].append(r)
    held = {s: sum(r.size for r in rs) for s, rs in by.items()}
    for s, rs in by.items():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    # in order of the digests, groups whole, and the largest shard as small as it can be
    flat = [(s, r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for s in sorted(by) for r in sorted(by[s], key=lambda r: r.slot)]
    assert [x[1:] for x in flat] == [x for g in groups.values() for x in g]
    at = 0
    for g in groups.values():
        assert len({x[0] for x in flat[at:at + len(g)]}) == 1
        at += len(g)
    assert max(held.values(), default=0) == least(sizes, shards)
    assert len(by) == min(shards, len(groups))
    return held


def test_partition_equals_dynamic_programming():
    rnd = random.Random(2)
    for _ in range(300):
        sizes = [rnd.choice([1, 2, 5, 9, 60]) for _ in range(rnd.randint(1, 30))]
        shards = rnd.randint(1, 8)
        p = Partition(np.array(sizes), np.ones(len(sizes), bool), shards)
        c = p.capacity(max(sizes))
        assert c == least(sizes, shards)
        cuts = [0, *p.cuts(c), len(sizes)]
        assert cuts == sorted(cuts) and max(sum(sizes[a:b]) for a, b in zip(cuts, cuts[1:])) == c
        assert sum(a < b for a, b in zip(cuts, cuts[1:])) == min(shards, len(sizes)) or max(sizes) > sum(sizes) / shards


def test_opened_cells_equal_the_full_list(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FIRST", 1)
    monkeypatch.setattr(sharding, "MORE", 1)
    rnd = random.Random(8)
    rows = sorted((f"{rnd.getrandbits(128):032x}", rnd.choice([1, 3, 40, 700])) for _ in range(800))
    rows[300] = (rows[300][0], 30_000)
    got = cut_points(spark.createDataFrame(rows, "digest string, bytes long").repartition(3), 7)
    full = Partition(np.array([b for _, b in rows]), np.ones(len(rows), bool), 7)
    c = full.capacity(30_000)
    assert got[0] == c
    assert [sum(d < p for d, _ in rows) for p in got[1]] == full.cuts(c)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    df = queries.queries()["op12_sharding"](spark, sf)
    assert dict(df.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int",
                               "slot": "bigint", "grown_shard": "int"}
    held = check(df.collect(), docs)
    assert min(held.values()) > 0.9 * max(held.values())


def test_odd_rows(spark):
    cols = "doc_id long, text string, size int, shard string, digest int, rank int, key string"
    docs = [(1, None), (2, ""), (None, "é"), (None, None), (3, "x" * 100_000), (4, "same"), (4, "same"), (5, "same")]
    df = spark.createDataFrame([(*d, 1, "s", 2, 3, "k") for d in docs], cols)
    check(shard_documents(df).collect(), docs)
    check(shard_documents(df, shards=3).collect(), docs, 3)
    assert shard_documents(df.where("false")).count() == 0


def test_hot_group(spark):
    docs = [(i, f"text number {i}") for i in range(400)] + [(1000 + i, "copied everywhere " * 3) for i in range(300)] + [(7, "row")] * 200
    held = check(shard_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(6)).collect(), docs)
    rest = sorted(held.values())[:-1]
    assert len(held) == 16 and rest[0] > 0
