import random
import re
from collections import defaultdict

import numpy as np

from kilonova.llm import queries
from kilonova.llm.packing import PRICE, SIZES, best_fit, pack_texts


def brute(lengths, sizes, price):
    """The same rule by linear search."""
    bins, out = [], []
    for i, n in enumerate(lengths):
        fits = [(size - used, b) for b, (size, used) in enumerate(bins) if size - used >= n]
        if fits:
            b = min(fits)[1]
        else:
            room = sum(s - u for s, u in bins)
            cost = [((s + price) / (n + min(s - n, max(0, sum(x for x in lengths[i + 1:] if x <= s - n) - room))), s) for s in sizes if s >= n]
            low = min(cost)[0]
            bins.append([min(s for c, s in cost if c <= low + 1e-12), 0])
            b = len(bins) - 1
        out.append((b, bins[b][1]))
        bins[b][1] += n
    return out, [min(s for s in sizes if s >= u) for _, u in bins]


def test_equals_linear_search():
    rnd = random.Random(1)
    for sizes in ((8,), (4, 16), (5, 9, 33)):
        for _ in range(60):
            lengths = sorted((rnd.randint(1, max(sizes)) for _ in range(rnd.randint(0, 40))), reverse=True)
            bins, offsets, size = best_fit(np.array(lengths, np.int64), sizes, 2)
            want, want_size = brute(lengths, sizes, 2)
            assert list(zip(bins.tolist(), offsets.tolist())) == want and size.tolist() == want_size


def check(rows, lengths):
    bins, got = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r.bin_id].append(r)
        got[r.doc_id].append((r.first_token, r.n_tokens, r.piece))
        assert r.bin_size in SIZES
    for rs in bins.values():
        rs.sort(key=lambda r: r.bin_offset)
        at = 0
        for r in rs:
            assert r.bin_offset == at
            at += r.n_tokens
        assert rs[0].bin_size == min(s for s in SIZES if s >= at)
    for k, n in lengths.items():
        at = 0
        for i, (first, size, piece) in enumerate(sorted(got[k])):
            assert (first, piece) == (at, i)
            at += size
        assert at == n
    return sum(r.n_tokens for r in rows) / sum(rs[0].bin_size for rs in bins.values()), len(bins)


def test_query(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = queries.queries()["op8_best_fit_packing"](spark, sf).collect()
    lengths = {d.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", d.text)) + 1 for d in docs}
    fill, n = check(rows, lengths)
    assert fill > 0.99
    # no dearer than any single size
    ours = sum({r.bin_id: r.bin_size + PRICE for r in rows}.values())
    assert ours <= sum(-(-sum(lengths.values()) // SIZES[-1]) * (s + PRICE) * SIZES[-1] / s for s in SIZES[-1:]) * 1.02


def test_odd_rows(spark):
    cols = "doc_id long, text string, piece string, rid string, key string, shard int"
    rows = [(1, None, "p", "r", "k", 1), (2, "", "p", "r", "k", 1), (3, "w " * 20_000, "p", "r", "k", 1), (4, "a\x0bb", None, None, None, None)]
    out = pack_texts(spark.createDataFrame(rows, cols)).collect()
    check(out, {1: 1, 2: 1, 3: 20_001, 4: 3})
    twice = pack_texts(spark.createDataFrame([(None, "a b")] * 2, "doc_id long, text string")).collect()
    assert [r.n_tokens for r in twice] == [3, 3] and {r.doc_id for r in twice} == {None}
    assert pack_texts(spark.createDataFrame([], cols)).count() == 0
