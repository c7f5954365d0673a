import math
import re
import zlib
from collections import Counter

import pytest

from kilonova.llm import lm_score, queries

COLS = "doc_id long, text string, score string, row string, key int"


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def brute(rows, order, mass):
    """Probabilities straight from the recursive definition."""
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    grams = Counter()
    for i, t in rows:
        if not held(i):
            w = ["<s>", *tokens(t)]
            grams.update([("<s>",)])
            for m in range(1, order + 1):
                grams.update(tuple(w[k:k + m]) for k in range(0 if m > 1 else 1, len(w) - m + 1))
    one = {g[0]: c for g, c in grams.items() if len(g) == 1 and g[0] != "<s>"}
    n, v = sum(one.values()), len(one)

    def p(w, h):
        if not h:
            return (one.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))
        return (grams[(*h, w)] + mass * p(w, h[1:])) / (grams[h] + mass)

    out = []
    for i, t in rows:
        w = tokens(t)
        full = ["<s>", *w]
        out.append((i, held(i), len(w), sum(x in one for x in w), n, sum(math.log10(p(x, ())) for x in w),
                    sum(math.log10(p(x, tuple(full[max(0, k - order + 2):k + 1]))) for k, x in enumerate(w))))
    return out


def compare(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[6], 6))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_query_equals_definition(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = [tuple(r) for r in queries.queries()["op3_lm_score"](spark, sf).collect()]
    compare([(g[0], g[1], g[2], g[3], g[4], g[5], g[6]) for g in got], brute(docs, lm_score.ORDER, lm_score.MASS))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_orders_blocks_and_odd_rows(spark, order, monkeypatch):
    monkeypatch.setattr(lm_score, "BLOCK_TOKENS", 30)
    texts = [None, "", " \t", "a", "A b a b a b", "É é a", "b\x0ba\nb", "x " * 50, "a b c d e f g", "a b c d e f g"]
    rows = [(i, t) for i, t in enumerate(texts * 3)] + [(None, "a b"), (None, None), (5, "a b a")]
    df = spark.createDataFrame([(i, t, "s", "r", 1) for i, t in rows], COLS)
    out = lm_score.score_texts(df, order=order).select("row.doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    compare([tuple(r) for r in out.collect()], brute(rows, order, lm_score.MASS))


@pytest.mark.parametrize("order", [2, 3, 4])
def test_long_texts_in_pieces(spark, order, monkeypatch):
    import random

    monkeypatch.setattr(lm_score, "PIECE", 7)
    rnd = random.Random(order)
    rows = [(i, " ".join(rnd.choice("abcde") for _ in range(rnd.randint(0, 60)))) for i in range(80)]
    out = lm_score.score_texts(spark.createDataFrame([(i, t, "s", "r", 1) for i, t in rows], COLS), order=order)
    out = out.select("row.doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    compare([tuple(r) for r in out.collect()], brute(rows, order, lm_score.MASS))


def test_context_helps_on_held_out_text(spark):
    rows = [r for r in queries.queries()["op3_lm_score"](spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([], COLS)
    assert lm_score.score_texts(df).count() == 0
    alone = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0][0]
    got = lm_score.score_texts(spark.createDataFrame([(alone, "a b", "s", "r", 1)], COLS)).collect()[0]
    assert (got.train_tokens, got.n_known, got.n_tokens) == (0, 0, 3) and got.score == pytest.approx(0)
