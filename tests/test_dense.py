"""The multilayer perceptron by passes over blocks: same loss as copies of rows, one pass for all folds."""
import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from kilonova.operators import dense, models

FEATS, CLASSES, SIZES = ["a", "b", "c"], [6, 15, 42], [3, 4, 3]


@pytest.fixture(scope="module")
def rows(spark):
    """Three uneven classes, five folds; one row without a value, one feature without a spread."""
    rng = np.random.default_rng(3)
    out = []
    for i in range(300):
        k = 0 if i % 10 < 6 else 1 if i % 10 < 9 else 2
        out.append((i, CLASSES[k], i % 5, None if i == 7 else float(rng.normal(k, 1)), float(rng.normal(-k, 2)), 4.0))
    return spark.createDataFrame(out, "object_id long, target int, fold int, a double, b double, c double").repartition(3).checkpoint()


def test_weighted_loss_is_that_of_the_copies(spark):
    rng = np.random.default_rng(5)
    x, label, copies, w = rng.normal(size=(40, 3)), rng.integers(0, 3, 40), np.array([1, 3, 2]), rng.normal(size=31)
    mean, factor = np.array([.1, -.2, 0]), np.array([2., 1, 0])
    df = spark.createDataFrame([(r.tolist(), int(k), 0) for r, k in zip(x, label)], "x array<double>, label long, fold long").repartition(3)
    blocks = dense.row_blocks(df, 40)
    values = dense.mean_losses(blocks, SIZES, {None: (mean, factor)}, {None: copies})
    loss, grad = values({None: w})[None]
    spread = [(((r - mean) * factor).tolist(), float(k)) for r, k in zip(x, label) for _ in range(copies[k])]
    long = spark.createDataFrame(spread, "x array<double>, label double").select(array_to_vector("x").alias("features"), "label")
    ref = MultilayerPerceptronClassifier(layers=SIZES, maxIter=0, blockSize=1, initialWeights=Vectors.dense(w)).fit(long)
    assert loss == pytest.approx(ref.summary().objectiveHistory[0], rel=1e-9)
    for i in (0, 7, 11, 12, 15, 16, 25, 30):
        step = np.zeros(31)
        step[i] = 1e-5
        both = [values({None: w + s * step})[None][0] for s in (1, -1)]
        assert grad[i] == pytest.approx((both[0] - both[1]) / 2e-5, rel=1e-4, abs=1e-8)
    blocks.unpersist()


def test_a_pass_reads_every_row_once_for_all_folds(rows, monkeypatch):
    read, passes, minimise = [], [], dense.minimise
    blocks = dense.row_blocks
    monkeypatch.setattr(dense, "row_blocks", lambda *a: read.append(blocks(*a)) or read[-1])

    def counted(values, starts, *rest):
        read.append(read[0].map(lambda b: (b[2], len(b[1]))).collect())
        return minimise(lambda p: passes.append(set(p)) or values(p), starts, *rest)
    monkeypatch.setattr(dense, "minimise", counted)
    nets = models.train_dense(rows, FEATS, hidden=(4,), classes=CLASSES, max_iter=8, fold="fold")
    assert set(nets) == {0, 1, 2, 3, 4} and passes[0] == set(nets) and len(passes) <= 30
    assert {f: sum(n for g, n in read[1] if g == f) for f in range(5)} == dict.fromkeys(range(5), 60)
    # a fold's network is the one trained on the other folds alone
    scaler, net = models.train_dense(rows.filter("fold != 2"), FEATS, hidden=(4,), classes=CLASSES, max_iter=8)
    assert np.allclose(net.weights.toArray(), nets[2][1].weights.toArray(), rtol=1e-6, atol=1e-8)
    assert np.allclose(scaler.mean.toArray(), nets[2][0].mean.toArray()) and np.allclose(scaler.std.toArray(), nets[2][0].std.toArray())


def test_network_is_as_good_as_on_copies(rows):
    scaler, net = models.train_dense(rows, FEATS, hidden=(4,), classes=CLASSES)
    data = models._assemble(rows, FEATS).withColumn("_label", models.class_index("target", CLASSES))
    copies = F.element_at(F.array(F.lit(1), F.lit(2), F.lit(6)), (F.col("_label") + 1).cast("int"))
    reps = scaler.transform(data.withColumn("_rep", F.explode(F.sequence(F.lit(1), copies))))
    fit = dict(featuresCol="zfeatures", labelCol="_label", layers=SIZES, seed=71, blockSize=1)
    old = MultilayerPerceptronClassifier(maxIter=100, **fit).fit(reps).summary().objectiveHistory[-1]
    new = MultilayerPerceptronClassifier(maxIter=0, initialWeights=net.weights, **fit).fit(reps).summary().objectiveHistory[0]
    assert new < old * 1.02


def test_a_class_outside_the_list_is_refused(rows):
    with pytest.raises(Exception, match="none of the classes given"):
        models.train_dense(rows, FEATS, hidden=(4,), classes=[6, 15], max_iter=1)


@pytest.mark.parametrize("memory", [1, 10])
def test_minimum_of_several_starts(memory):
    def values(points):
        return {k: (float(100 * (x[1] - x[0] ** 2) ** 2 + (1 - x[0]) ** 2),
                    np.array([-400 * x[0] * (x[1] - x[0] ** 2) - 2 * (1 - x[0]), 200 * (x[1] - x[0] ** 2)])) for k, x in points.items()}
    got = dense.minimise(values, {"p": np.array([-1.2, 1.0]), "q": np.array([2.0, 2.0])}, max_iter=2000, tol=1e-12, memory=memory)
    for x, history in got.values():
        assert np.allclose(x, 1, atol=1e-3) and history == sorted(history, reverse=True)
