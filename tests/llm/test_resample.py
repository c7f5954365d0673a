import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from kilonova.llm import queries, resample as rs, sorted_ranks
from kilonova.llm.resample import features, gumbel, resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def grams(text):
    w = WORD.findall((text or "").translate(LOWER))
    return w, [" ".join(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(docs, targets, min_words=20, percent=5, seed=42):
    """(id, n_words, n_features, weight, score) by order of drawing, and how many are drawn."""
    crc = lambda g: zlib.crc32(g.encode()) % 10_000
    s, t = Counter(), Counter()
    cut = [(i, *grams(x)) for i, x in docs]
    for _, _, g in cut:
        s.update(map(crc, g))
    for x in targets:
        t.update(map(crc, grams(x)[1]))
    ss, tt = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ss + 10000) / ((s[b] + 1) * (tt + 10000))))
    out = []
    for i, w, g in cut:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(crc(x)) for x in g)
        out.append((i, len(w), len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    return out, able[:percent * len(able) // 100]


def same(df, docs, targets, **params):
    rows, drawn = brute(docs, targets, **params)
    got = [tuple(r) for r in df.collect()]
    none = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted((r[:-1] for r in got), key=none) == sorted(rows, key=none)
    assert [r[:-1] for r in sorted((r for r in got if r[-1] is not None), key=lambda r: r[-1])] == drawn
    assert sorted(r[-1] for r in got if r[-1] is not None) == list(range(1, len(drawn) + 1))


def odd_texts(rnd, n):
    pieces = ["A", "bc", " ", "\n", "é", "日本語", "0", "-", "\x00", "Zz9", "x" * 63, "y" * 64, "w" * 65, "v" * 200, "_", " ", "~", "{"]
    return ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


def test_features_equal_zlib(monkeypatch):
    rnd = random.Random(5)
    for chunk in (1, 7, 300, 1 << 19):
        monkeypatch.setattr(rs, "_CHUNK", chunk)
        texts = [None, "", *odd_texts(rnd, 60), "long " * 300 + "tail" * 900, "-", "End"]
        got, words = defaultdict(Counter), Counter()
        for i, w, text, h in features(pa.array(texts)):
            for k, v in enumerate(w.tolist()):
                words[i + k] += v
            for k, b in zip(text.tolist(), h.tolist()):
                got[i + k][b] += 1
        for i, x in enumerate(texts):
            w, g = grams(x)
            assert words[i] == len(w) and got[i] == Counter(zlib.crc32(y.encode()) % 10_000 for y in g), (chunk, i, x)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    df = queries.queries()["op13_importance_resample"](spark, sf)
    assert df.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in df.dtypes} == {"bigint"}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows, drawn = brute(docs, [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    got = {r.doc_id: tuple(r)[1:] for r in df.collect()}
    rank = {r[0]: k for k, r in enumerate(drawn, 1)}
    assert got == {r[0]: (*r[2:], rank.get(r[0])) for r in rows} and len(got) == len(docs)


def test_odd_rows(spark):
    rnd = random.Random(7)
    cols = "doc_id long, text string, key string, rank int, score string, id long"
    docs = [(i, t) for i, t in enumerate(odd_texts(rnd, 40))] + [(None, "a b c " * 9), (None, None), (900, None), (901, "")]
    docs += [(77, "one two three " * 8)] * 30 + [(None, "one two three " * 8)] * 5 + [(902, "word " * 200_000)]
    df = spark.createDataFrame([(*d, "k", 1, "s", 3) for d in docs], cols).repartition(5)
    target = spark.createDataFrame([("one two", 1), (None, 2), ("", 3)], "text string, doc_id long")
    same(resample(df, target, min_words=3, percent=60), docs, ["one two", None, ""], min_words=3, percent=60)
    same(resample(df, target.where("false")), docs, [])
    assert resample(df.where("false"), target).count() == 0


def test_ranks_by_regular_sampling(spark, monkeypatch):
    monkeypatch.setattr(sorted_ranks, "_SMALL", 50)
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 5), rnd.choice("abc"), i) for i in range(900)] + [(3, "b", 7)] * 600
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        df = spark.createDataFrame(rows, "a long, b string, c long").repartition(6)
        got = sorted_ranks.ranked(sorted_ranks.sorted_runs(df, ["a", "b"], "t"), ["a", "b"], "t").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(r["rank"] for r in got) == list(range(1, 1501))
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r["rank"])] == sorted((a, b) for a, b, _ in rows)
    assert sorted((r.a, r.b, r.c) for r in got) == sorted(rows)


def test_gumbel():
    assert gumbel(42, "1") == math.floor(-1000 * math.log(-math.log((0x03ddf851 + 0.5) / 2 ** 32)))
    assert np.isfinite(gumbel(42, None))
