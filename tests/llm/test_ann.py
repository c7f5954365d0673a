import numpy as np
import pytest

from kilonova.llm import queries
from kilonova.llm.ann import Codes, nearest


def brute(ids, vecs, qid, q, k):
    d = np.sqrt(((vecs - q) ** 2).sum(1))
    at = [i for i in np.lexsort((ids, d)) if ids[i] != qid][:k]
    return [(int(ids[i]), d[i]) for i in at]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_the_query(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()
    ids, vecs = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    got = {}
    for r in queries.queries()["op6_nearest_vectors"](spark, f"/root/testdata/{sf}").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i in ids.tolist() if i % 100 == 0}
    hits = total = 0
    for qid, found in got.items():
        want = brute(ids, vecs, qid, vecs[ids == qid][0], 10)
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11))
        score = {int(i): s for i, s in zip(ids, np.sqrt(((vecs - vecs[ids == qid][0]) ** 2).sum(1)))}
        assert all(abs(s - score[v]) < 1e-12 for _, v, s in found)
        hits += len({v for _, v, _ in found} & {v for v, _ in want})
        total += 10
    assert hits / total >= 0.99


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((2000, 48)) + 1
    c = Codes(np.arange(2000), x, x.mean(0))
    low, high = c.bounds(x[:50])
    true = ((x[:50, None] - x[None]) ** 2).sum(2)
    assert ((low <= true) & (true <= high)).mean() > 0.995 and c.bits.shape == (2000, 6)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]),
            (8, []), (None, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (100, [1.0, 0.0]), (100, [1.0, 0.0]), (200, [0.0, 0.0]), (300, [5.0])]
    df = spark.createDataFrame([(i, v, "s", 1) for i, v in rows], "vec_id long, embedding array<double>, score string, rank int")
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in nearest(df, df.where("vec_id % 100 = 0"), k=3).collect())
    assert got == [(0, 1, 100, 0.0), (0, 2, 100, 0.0), (0, 3, 1, 0.5), (100, 1, 0, 0.0), (100, 2, 1, 0.5), (100, 3, 2, 0.5)]
    assert nearest(df.limit(0), df.limit(0)).count() == 0


def test_one_vector_in_a_third_of_all_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((900, 16))
    x[::3] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in nearest(df, df.where("vec_id % 100 = 0")).collect()}
    for q in range(0, 900, 100):
        want = brute(np.arange(900), x, q, x[q], 10)
        assert [got[q, r][1] for r in range(1, 11)] == pytest.approx([d for _, d in want])
        if q % 3 == 0:
            assert [got[q, r][0] for r in range(1, 11)] == [i for i, _ in want]


@pytest.mark.parametrize("who,scale", [(450, 1e40), (450, 1e43), (450, 1e160), (450, 1e300), (300, 1e40), (300, 1e200), (7, 1e-200)])
def test_huge_and_tiny_vectors(spark, who, scale):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((900, 16))
    x[who] *= scale
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest(df, df.where("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert {q: len(v) for q, v in got.items()} == {q: 10 for q in range(0, 900, 100)}
    for q, found in got.items():
        assert all(np.isfinite(s) for _, _, s in found)
        if q != who:
            assert [v for _, v, _ in sorted(found)] == [v for v, _ in brute(np.arange(900), x, q, x[q], 10)]
