"""Model training, cross-validation and search as Spark ML jobs.

Re-aimed: the boosted-tree / recurrent trainers of the reference become Spark
ML estimators (every fit is a distributed job).  The only driver-side loops
are over folds and parameter settings -- a handful of iterations, never over
rows.  Out-of-fold predictions are unions of held-out transforms keyed by
object_id, in the long (object_id, class, p) form the scoring operators use.
"""
from __future__ import annotations

import itertools
import random

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import dense, evaluation

_ROW = StructType([StructField("zfeatures", VectorUDT()), StructField("_label", DoubleType())])


def _assemble(df: DataFrame, features: list[str]) -> DataFrame:
    filled = df.na.fill(0.0, subset=features)  # trees need no scaling; NULL -> 0 (P13)
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(filled)


def _with_sample_weight(df: DataFrame, label: str) -> DataFrame:
    """M5: sample weight N / n_class (one grouped aggregate, broadcast back)."""
    w = evaluation.class_balance(df.select(label), label).select(label, "sample_weight")
    return df.join(F.broadcast(w), label, "left")


def class_index(label: str, classes: list[int]) -> F.Column:
    """Class id -> dense index 0..k-1 in sorted class order."""
    return (F.array_position(F.array(*[F.lit(c) for c in sorted(classes)]), F.col(label)) - 1).cast("double")


def train_multiclass(df: DataFrame, features: list[str], label: str = "target", params: dict | None = None,
                     seed: int = 71, classes: list[int] | None = None):
    """M6: weighted multi-class random forest on the dense class index."""
    p = {"numTrees": 30, "maxDepth": 6}
    p.update(params or {})
    classes = classes or [r[0] for r in df.select(label).distinct().collect()]  # <= number of classes
    data = _with_sample_weight(_assemble(df, features), label).withColumn("_label", class_index(label, classes))
    rf = RandomForestClassifier(featuresCol="features", labelCol="_label", weightCol="sample_weight", seed=seed, **p)
    return rf.fit(data)


def predict_long(model, df: DataFrame, features: list[str], classes: list[int], id_col: str = "object_id") -> DataFrame:
    """Probabilities in long form (object_id, class, p); index i is the i-th class in sorted order."""
    pr = model.transform(_assemble(df, features)).select(id_col, vector_to_array("probability").alias("_p"))
    return pr.select(id_col, F.inline(F.array(*[
        F.struct(F.lit(c).alias("class"), F.coalesce(F.get(F.col("_p"), i), F.lit(0.0)).alias("p"))
        for i, c in enumerate(sorted(classes))])))


def cross_validate(df: DataFrame, features: list[str], folds: DataFrame, classes: list[int], label: str = "target",
                   params: dict | None = None, id_col: str = "object_id"):
    """M7: per fold train on the other folds, predict the held-out fold; returns
    (out-of-fold predictions long, fitted models)."""
    # every fit and prediction re-reads the matrix: checkpoint it once into the shared
    # checkpoint folder (reliable; also cuts the lineage for retries)
    data = df.join(folds.select(id_col, "fold"), id_col, "inner").checkpoint(eager=True)
    k = data.agg(F.max("fold")).first()[0] + 1   # number of folds: one value
    preds, models = [], []
    for f in range(k):
        m = train_multiclass(data.filter(F.col("fold") != f), features, label, params, classes=classes)
        preds.append(predict_long(m, data.filter(F.col("fold") == f), features, classes, id_col))
        models.append(m)
    oof = preds[0]
    for p in preds[1:]:
        oof = oof.unionByName(p)
    return oof, models


def feature_importance(models, features: list[str], top: int | None = None) -> DataFrame:
    """M8 / O3: mean importance over folds, sorted descending (top-k if given)."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    rows = [(f, i, float(m.featureImportances[j])) for i, m in enumerate(models) for j, f in enumerate(features)]
    imp = spark.createDataFrame(rows, "feature string, model int, importance double")
    out = imp.groupBy("feature").agg(F.avg("importance").alias("importance")).orderBy(F.desc("importance"), "feature")
    return out.limit(top) if top else out


def select_features(df: DataFrame, features: list[str], folds: DataFrame, truth: DataFrame, weights: DataFrame,
                    classes: list[int], step: int = 10, rounds: int = 3, label: str = "target"):
    """M9: rounds of the top step*r features by importance; keep the best OOF score.
    Falls back to all features when no round improves (defect B6)."""
    df = df.checkpoint(eager=True)
    oof, models = cross_validate(df, features, folds, classes, label)
    best = (evaluation.weighted_logloss(oof, truth, weights).first()["wloss"], features)
    ranked = [r["feature"] for r in feature_importance(models, features).collect()]  # one row per feature
    for r in range(1, rounds + 1):
        subset = ranked[: step * r]
        if not subset or len(subset) >= len(features):
            break
        o, _ = cross_validate(df, subset, folds, classes, label)
        score = evaluation.weighted_logloss(o, truth, weights).first()["wloss"]
        if score < best[0]:
            best = (score, subset)
    return best


def random_search(df: DataFrame, features: list[str], folds: DataFrame, truth: DataFrame, weights: DataFrame,
                  classes: list[int], space: dict, n: int = 3, seed: int = 7, label: str = "target") -> DataFrame:
    """Seeded random parameter settings, out-of-fold score per setting."""
    df = df.checkpoint(eager=True)
    rnd = random.Random(seed)
    grid = list(itertools.product(*space.values()))
    settings = [dict(zip(space.keys(), g)) for g in rnd.sample(grid, min(n, len(grid)))]
    rows = []
    for i, p in enumerate(settings):
        oof, _ = cross_validate(df, features, folds, classes, label, params=p)
        rows.append((i, str(sorted(p.items())), evaluation.weighted_logloss(oof, truth, weights).first()["wloss"]))
    spark = df.sparkSession
    return spark.createDataFrame(rows, "setting int, params string, wloss double")


def predict_redshift(df: DataFrame, features: list[str], folds: DataFrame, target: str = "hostgal_specz",
                     id_col: str = "object_id") -> DataFrame:
    """Out-of-fold random-forest regression of a redshift column (rows with a
    known target train; every row gets an out-of-fold prediction)."""
    data = _assemble(df.join(folds.select(id_col, "fold"), id_col, "inner"), features)
    # read twice a fold: only what is read
    data = data.select(id_col, "fold", F.col(target).cast("double").alias(target), "features").checkpoint(eager=True)
    k = data.agg(F.max("fold")).first()[0] + 1
    outs = []
    for f in range(k):
        train = data.filter((F.col("fold") != f) & F.col(target).isNotNull())
        m = RandomForestRegressor(featuresCol="features", labelCol=target, numTrees=30, maxDepth=6, seed=71).fit(train)
        outs.append(m.transform(data.filter(F.col("fold") == f)).select(id_col, F.col("prediction").alias("predict_specz")))
    out = outs[0]
    for o in outs[1:]:
        out = out.unionByName(o)
    return out


def encode_sequences(seq: DataFrame, k: int = 16, channels=("lag", "flux")) -> DataFrame:
    """M14 (re-aimed autoencoder) for narrow sequences, whose matrix of widths squared fits the driver;
    ``components.encode_rows`` does the same at any width.  Per object, the padded scaled sequences of all bands side by side -- every band keeps
    its own slots, zeros where the object lacks it -- projected on ``k`` principal components.  Always ``k`` values: what
    a narrower input cannot give is 0."""
    widths = {r["passband"]: r["n"] for r in seq.groupBy("passband").agg(F.max(F.size(channels[0])).alias("n")).collect()}   # one row a band
    parts = []
    for b in sorted(widths):
        own = F.max(F.when(F.col("passband") == b, F.concat(*[F.col(c) for c in channels])))
        parts.append(F.coalesce(own, F.array_repeat(F.lit(0.0), widths[b] * len(channels))))
    flat = seq.groupBy("object_id").agg(F.concat(*parts).alias("x"))
    width = sum(widths.values()) * len(channels)
    vec = flat.withColumn("features", array_to_vector("x"))
    model = PCA(k=min(k, width), inputCol="features", outputCol="enc").fit(vec)
    missing = F.array_repeat(F.lit(0.0), k - min(k, width))
    return model.transform(vec).select("object_id", F.concat(vector_to_array("enc"), missing).alias("encoding"))


def masked_mse(seq_pred: DataFrame, seq_true: DataFrame, col: str = "flux") -> DataFrame:
    """M14 loss: mean squared error over non-padded steps (padding is exact 0)."""
    j = seq_pred.select("object_id", "passband", F.col(col).alias("p")).join(
        seq_true.select("object_id", "passband", F.col(col).alias("t"), "length"), ["object_id", "passband"])
    e = j.select(F.inline(F.arrays_zip(F.slice("p", 1, F.col("length")).alias("p"),
                                       F.slice("t", 1, F.col("length")).alias("t"))))
    return e.agg(F.avg(F.pow(F.col("p") - F.col("t"), 2)).alias("masked_mse"))


def pseudo_label(test_pred: DataFrame, threshold: float = 0.9, id_col: str = "object_id") -> DataFrame:
    """Test objects whose top class probability exceeds ``threshold`` with that class."""
    top = test_pred.groupBy(id_col).agg(F.max_by("class", F.struct("p", -F.col("class"))).alias("target"),
                                        F.max("p").alias("p_max"))
    return top.filter(F.col("p_max") > threshold).select(id_col, "target")


def with_pseudo_labels(train: DataFrame, test: DataFrame, test_pred: DataFrame, threshold: float = 0.9, label: str = "target",
                       id_col: str = "object_id") -> DataFrame:
    """The training rows and the confidently predicted test rows with their predicted class; ``pseudo`` tells them
    apart, so that class weights (M5) can be counted on the real ones."""
    extra = test.drop(label).join(pseudo_label(test_pred, threshold, id_col).withColumnRenamed("target", label), id_col)
    return train.withColumn("pseudo", F.lit(False)).unionByName(extra.withColumn("pseudo", F.lit(True)), allowMissingColumns=True)


class WeightedLogLoss(Evaluator):
    """M3 as an evaluator of Spark ML, for any tuner that takes one.  Reads ``object_id``, the label and the
    probability vector of the classes in sorted order; smaller is better."""

    def __init__(self, weights: DataFrame, classes: list[int], label: str = "target", id_col: str = "object_id"):
        super().__init__()
        self.weights, self.classes, self.label, self.id_col = weights, sorted(classes), label, id_col

    def _evaluate(self, dataset: DataFrame) -> float:
        long = dataset.select(self.id_col, vector_to_array("probability").alias("_p")).select(self.id_col, F.inline(F.array(*[
            F.struct(F.lit(c).alias("class"), F.get(F.col("_p"), i).alias("p")) for i, c in enumerate(self.classes)])))
        return evaluation.weighted_logloss(long, dataset.select(self.id_col, self.label), self.weights, self.label, self.id_col).first()["wloss"]

    def isLargerBetter(self) -> bool:
        return False


def train_dense(df: DataFrame, features: list[str], label: str = "target", hidden: tuple[int, ...] = (32,),
                classes: list[int] | None = None, seed: int = 71, max_iter: int = 100, fold: str | None = None):
    """M18 (re-aimed dense head): multilayer perceptron on standardised features; (scaler, network), or with a column
    ``fold`` a dictionary of them, each trained on the rows of the other folds.

    Classes are balanced by as many copies of a row as bring its class to the size of the largest (M5 by replication).
    The scalers are fitted on the copies; the passes count a row once, with its copies as its weight, and serve the
    networks of all folds (``dense``), which is the same loss.  The first weights are those of Spark's estimator for the
    seed, the fitted network is Spark's."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import StandardScaler

    spark = df.sparkSession
    classes = classes or [r[0] for r in df.select(label).distinct().collect()]   # <= number of classes
    sizes = [len(features), *hidden, len(classes)]
    own = F.lit(-1) if fold is None else F.col(fold)
    data = _assemble(df, features).select("features", class_index(label, classes).alias("_label"), own.cast("long").alias("_fold")) \
        .filter(F.col("_label").isNotNull())
    n = {(r["_fold"], int(r["_label"])): r["count"] for r in data.groupBy("_fold", "_label").count().collect()}   # folds x classes
    scalers, scales, copies = {}, {}, {}
    for f in [None] if fold is None else sorted({k for k, _ in n}):
        rows = [sum(c for (k, j), c in n.items() if j == i and k != f) for i in range(len(classes))]
        copies[f] = np.array([max(1, -(-max(rows) // r)) if r else 1 for r in rows])
        times = F.get(F.array(*[F.lit(int(c)) for c in copies[f]]), F.col("_label").cast("int"))
        reps = (data if f is None else data.filter(F.col("_fold") != f)).withColumn("_rep", F.explode(F.sequence(F.lit(1), times)))
        scalers[f] = StandardScaler(inputCol="features", outputCol="zfeatures", withMean=True, withStd=True).fit(reps)
        std = scalers[f].std.toArray()
        scales[f] = scalers[f].mean.toArray(), np.divide(1, std, out=np.zeros_like(std), where=std != 0)

    def network(**weights):
        """Spark's model before its first round; the row only gives the columns their types."""
        row = spark.createDataFrame([(Vectors.zeros(len(features)), 0.0)], _ROW)
        return MultilayerPerceptronClassifier(featuresCol="zfeatures", labelCol="_label", seed=seed, maxIter=0, layers=sizes,
                                              **weights).fit(row)

    blocks = dense.row_blocks(data.select(vector_to_array("features").alias("x"), F.col("_label").cast("long").alias("label"),
                                          F.col("_fold").alias("fold")), sum(n.values()))
    try:
        best = dense.minimise(dense.mean_losses(blocks, sizes, scales, copies), dict.fromkeys(copies, network().weights.toArray()), max_iter)
    finally:
        blocks.unpersist()
    out = {f: (scalers[f], network(initialWeights=Vectors.dense(w))) for f, (w, _) in best.items()}
    return out[None] if fold is None else out
