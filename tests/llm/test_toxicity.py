import zlib

import numpy as np
import pyarrow as pa
import pytest

from kilonova.llm import queries
from kilonova.llm.toxicity import Params, fit, score_texts, scores, train

COLS = "doc_id long, text string, score string, row string"


def held(i, mod=5):
    return zlib.crc32(str(i).encode()) % mod == 0


def test_non_negative_fit_on_a_planted_split():
    """Positives hold one of five words; a tenth of the unlabelled texts are positives, too."""
    rng = np.random.default_rng(3)
    common = np.arange(100, 400, dtype=np.uint64)

    def text(bad):
        w = rng.choice(common, 40, replace=False)
        return np.unique(np.append(w, rng.choice(5, 2, replace=False).astype(np.uint64)) if bad else w)

    pos, unl = [text(True) for _ in range(300)], [text(i % 10 == 0) for i in range(1500)]
    model = fit(pos, unl, 0.1)
    of = lambda t: model.bias + sum(w for h, w in zip(model.words, model.weights) if h in set(t.tolist()))
    good = [of(text(False)) < 0 for _ in range(400)]
    bad = [of(text(True)) > 0 for _ in range(400)]
    assert np.mean(good) > 0.98 and np.mean(bad) > 0.95


def test_scores_of_odd_texts():
    model = fit([np.arange(9, dtype=np.uint64)] * 6, [], 0.2, Params(min_z=0, min_posterior=0))
    got = scores(model, pa.array([None, "", " \n", "x" * 100_000]))
    assert np.allclose(got, 1 / (1 + np.exp(-model.bias)))
    assert len(scores(model, pa.array([], pa.string()))) == 0
    assert (scores(fit([], [], 0.0), pa.array(["a"])) < 1e-20).all()


@pytest.fixture(scope="module")
def corpus(spark):
    """Larger than the small tables: real texts of sf0.1 with its labels."""
    d = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet")


def test_held_out_accuracy(spark, corpus):
    docs, labels = corpus
    model = train(docs, labels)
    truth = {r.doc_id: r.toxic for r in labels.collect() if held(r.doc_id)}
    got = {r.row.doc_id: r.score for r in score_texts(docs, model).collect() if r.row.doc_id in truth}
    right = {x: [(got[i] >= 0.5) == (x == 1) for i, t in truth.items() if t == x and i in got] for x in (0, 1)}
    # some of the rows labelled toxic hold no word that sets them apart
    assert np.mean(right[0]) >= 0.98 and np.mean(right[1]) >= 0.85 and len(right[1]) > 20


def test_query_rows(spark):
    rows = queries.queries()["op4_toxicity"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "you idiot", "s", "r"), (1, "you idiot", "s", "r"), (None, None, None, None), (2, "", "s", "r")], COLS)
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    for lab in (labels, labels.limit(0)):
        assert score_texts(docs, train(docs, lab)).count() == 4
    none = docs.limit(0)
    assert score_texts(none, train(none, labels)).count() == 0
