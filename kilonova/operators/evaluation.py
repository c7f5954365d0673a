"""Folds, class weights, scoring and prediction post-processing.

Nothing here brings rows to the driver.  Lookup tables with a size fixed by
the problem (14 classes, k folds) are the only broadcast sides; per-object
work is partitioned by ``object_id``.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.core import ALL_CLASSES, GALACTIC_CLASSES, PROB_EPS, clip_prob, safe_div
from ..functions.windows import join_back

# Fixed class weights of the competition metric.
CLASS_WEIGHTS = {6: 1.00104, 15: 2.00189, 16: 1.00104, 42: 1.00104, 52: 1.00104, 53: 1.00000, 62: 1.00104,
                 64: 2.00710, 65: 1.00104, 67: 1.00104, 88: 1.00104, 90: 1.00104, 92: 1.00104, 95: 1.00104}
UNKNOWN_MEAN = 0.18


def class_table(spark: SparkSession) -> DataFrame:
    """(target, weight, domain) for the 14 classes (a fixed 14-row table)."""
    rows = [(c, CLASS_WEIGHTS[c], "gal" if c in GALACTIC_CLASSES else "exgal") for c in ALL_CLASSES]
    return spark.createDataFrame(rows, "target INT, weight DOUBLE, domain STRING")


def order_key(id_col: str, seed: int) -> Column:
    """Seeded pseudo-random order of ids that SQL engines can reproduce: md5 of '<id>:<seed>'."""
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))


def distributed_rank(df: DataFrame, order: str, group: str | None = None, hex_digits: int = 3) -> DataFrame:
    """0-based rank of each row by ``order`` within ``group`` without a per-group task.

    ``order`` is a hex hash string (``order_key``), so its first ``hex_digits``
    characters split every group into 16^hex_digits ordered, evenly filled
    buckets: a hot group is spread over thousands of tasks.  Each bucket
    counts its rows; the prefix sums of those counts (a table of groups x
    buckets rows, bounded by the bucket count) give each bucket's first rank,
    added to the row number inside the bucket.  Everything is a deterministic
    function of the data, so a recomputed partition gets the same ranks.
    """
    gcol = [group] if group else []
    keyed = df.withColumn("_b", F.substring(F.col(order), 1, hex_digits))
    counts = keyed.groupBy(*gcol, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.partitionBy(*gcol).orderBy("_b") if gcol else Window.orderBy("_b")
    offsets = counts.withColumn("_off", F.sum("_cnt").over(w) - F.col("_cnt")).drop("_cnt")
    local = keyed.withColumn("_local", F.row_number().over(Window.partitionBy(*gcol, "_b").orderBy(order)) - 1)
    return (join_back(local, offsets, [*gcol, "_b"])
            .withColumn("rank", (F.col("_off") + F.col("_local")).cast("long"))
            .drop("_b", "_off", "_local"))


def stratified_folds(df: DataFrame, id_col: str = "object_id", label: str = "target", k: int = 5,
                     seed: int = 71) -> DataFrame:
    """M1: fold = (rank of the seeded hash within the class) mod k -> per-class balanced folds."""
    keyed = df.select(id_col, label, order_key(id_col, seed).alias("_h"))
    ranked = distributed_rank(keyed, "_h", label)
    return ranked.select(id_col, label, (F.col("rank") % k).cast("int").alias("fold"))


def kfold(df: DataFrame, id_col: str = "object_id", k: int = 5, seed: int = 71) -> DataFrame:
    """M2: unstratified folds by the seeded hash order."""
    keyed = df.select(id_col, order_key(id_col, seed).alias("_h"))
    ranked = distributed_rank(keyed, "_h")
    return ranked.select(id_col, (F.col("rank") % k).cast("int").alias("fold"))


def class_balance(truth: DataFrame, label: str = "target", weights: DataFrame | None = None) -> DataFrame:
    """M5: per class count, normalised class weight and sample weight N / n_class."""
    counts = truth.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    out = counts.withColumn("sample_weight", safe_div(total.cast("double"), F.col("n").cast("double")))
    if weights is not None:
        wsum = weights.agg(F.sum("weight")).scalar()
        out = out.join(F.broadcast(weights.select(label, "weight")), label, "left") \
                 .withColumn("weight_norm", F.col("weight") / wsum).drop("weight")
    return out


def _centroid_models(features: DataFrame, label: str, cols: list[str], classes: list[int] | None, fold_col: str | None) -> Column:
    """All models as one scalar array of structs (f, c, and per column centre, scale and centroid): one entry per fold
    and class.  The model of fold f standardises and averages over the rows of the other folds only; each is a
    conditional aggregate, so no row is copied per fold."""
    k = features.agg(F.max(fold_col)).first()[0] + 1 if fold_col else 1   # number of folds: one value
    other = [f"{fold_col} <> {f}" if fold_col else "true" for f in range(k)]
    st = features.agg(F.struct(*[F.expr(f"{fn}(CASE WHEN {other[f]} THEN {c} END)").alias(f"{c}_{n}{f}")
                                 for f in range(k) for c in cols for n, fn in (("m", "avg"), ("s", "stddev_pop"))])).scalar()
    known = (features if classes is None else features.filter(F.col(label).isin(classes))).withColumn("_st", st)
    aggs = [F.count(F.when(F.expr(other[f]), 1)).alias(f"n{f}") for f in range(k)]
    for f in range(k):
        for c in cols:
            z = F.coalesce(safe_div(F.col(c) - F.col("_st")[f"{c}_m{f}"], F.col("_st")[f"{c}_s{f}"]), F.lit(0.0))
            aggs.append(F.avg(F.when(F.expr(other[f]), z)).alias(f"{c}_c{f}"))
    cents = known.groupBy(label).agg(*aggs).withColumn("_st", st)
    entries = F.array(*[F.struct(F.lit(f).alias("f"), F.col(label).alias("c"), F.col(f"n{f}").alias("n"), *[x for c in cols for x in (
        F.col("_st")[f"{c}_m{f}"].alias(f"{c}_m"), F.col("_st")[f"{c}_s{f}"].alias(f"{c}_s"), F.col(f"{c}_c{f}").alias(f"{c}_c"))]) for f in range(k)])
    # subqueries can not sit inside higher-order functions: bind the entries to a column first
    rows = cents.select(F.explode(entries).alias("e")).filter("e.n > 0")
    return rows.agg(F.sort_array(F.collect_list("e"))).scalar()


def _distance(e: Column, cols: list[str]) -> Column:
    """Squared distance of the row to an entry's centroid in the entry's own standardised space (NULL -> 0)."""
    z = [F.coalesce(safe_div(F.col(c) - e[f"{c}_m"], e[f"{c}_s"]), F.lit(0.0)) for c in cols]
    return F.aggregate(F.array(*[F.pow(x - e[f"{c}_c"], 2) for x, c in zip(z, cols)]), F.lit(0.0), lambda a, x: a + x)


def centroid_probabilities(features: DataFrame, label: str, cols: list[str], classes: list[int] | None = None,
                           id_col: str = "object_id", fold_col: str | None = None) -> DataFrame:
    """A nearest-centroid classifier used as the probability source of the
    scoring operators: p(c | x) = softmax_c(-||z(x) - mu_c||^2), z = columns
    standardised over the training rows (NULL -> 0).

    With ``fold_col`` the model of fold f (standardisation and centroids) is
    fitted on the rows of the other folds and each row is scored by the model
    of its own fold (out-of-fold predictions, M7).

    The fitted model is (k x) at most 14 centroid rows collected into a
    scalar-subquery array, so scoring is a per-row array transform, not a join.
    Returns long form (object_id, class, p).

    The per-object feature table is read by several scalar subqueries and by
    the scoring pass, so it is checkpointed once into the shared
    ``spark.checkpoint.dir`` (reliable: computed once, lineage cut for retries).
    """
    features = features.checkpoint(eager=True)
    # subqueries can not sit inside lambdas: bind the model array to a column first
    rows = features.withColumn("_model", _centroid_models(features, label, cols, classes, fold_col))
    own = F.col(fold_col) if fold_col else F.lit(0)
    mine = F.filter("_model", lambda e: e["f"] == own)
    scored = rows.select(id_col, F.transform(mine, lambda e: F.struct(e["c"].alias("cls"), (-_distance(e, cols)).alias("s"))).alias("_sc"))
    scored = scored.withColumn("_mx", F.array_max(F.transform("_sc", lambda e: e["s"])))
    scored = scored.withColumn("_den", F.aggregate("_sc", F.lit(0.0), lambda a, e: a + F.exp(e["s"] - F.col("_mx"))))
    long = scored.select(id_col, "_mx", "_den", F.inline("_sc"))
    return long.select(id_col, F.col("cls").cast("int").alias("class"),
                       (F.exp(F.col("s") - F.col("_mx")) / F.col("_den")).alias("p"))


def centroid_ensemble(features: DataFrame, label: str, cols: list[str], fold_col: str = "fold",
                      id_col: str = "object_id") -> DataFrame:
    """M12 with the centroid models of M7: every row is scored by all k fold
    models (each fitted without its fold) and the class probabilities are
    averaged over the models.  Long form (object_id, class, p)."""
    features = features.checkpoint(eager=True)
    rows = features.withColumn("_model", _centroid_models(features, label, cols, None, fold_col))
    long = rows.select(id_col, F.inline(F.transform("_model", lambda e: F.struct(
        e["f"].alias("model"), e["c"].alias("cls"), (-_distance(e, cols)).alias("s")))))
    w = Window.partitionBy(id_col, "model")   # one row a class
    long = long.withColumn("_mx", F.max("s").over(w))
    long = long.withColumn("p", F.exp(F.col("s") - F.col("_mx")) / F.sum(F.exp(F.col("s") - F.col("_mx"))).over(w))
    return long.groupBy(id_col, F.col("cls").cast("int").alias("class")).agg(F.avg("p").alias("p"))


def weighted_logloss(pred: DataFrame, truth: DataFrame, weights: DataFrame, label: str = "target",
                     id_col: str = "object_id", eps: float = PROB_EPS) -> DataFrame:
    """M3: -sum_c w_c * mean_{i in c} log(clip(p_i,c)) / sum_c w_c over the classes present.

    ``pred`` is long (object_id, class, p); objects without a row for their
    true class count as p = 0 (clipped to eps).  One-row result.
    """
    t = truth.select(id_col, F.col(label).cast("int").alias(label))
    pt = (t.join(pred.select(id_col, F.col("class").alias(label), "p"), [id_col, label], "left")
          .withColumn("logp", F.log(clip_prob(F.coalesce(F.col("p"), F.lit(0.0)), eps))))
    per_class = pt.groupBy(label).agg(F.avg("logp").alias("mean_logp"), F.count(F.lit(1)).alias("n"))
    j = per_class.join(F.broadcast(weights.select(label, "weight")), label, "inner")
    return j.agg((-F.sum(F.col("weight") * F.col("mean_logp")) / F.sum("weight")).alias("wloss"),
                 F.sum("n").alias("n_objects"), F.count(F.lit(1)).alias("n_classes"))


def class_share(truth: DataFrame, label: str = "target") -> DataFrame:
    """Share of every class (one row a class)."""
    n = truth.agg(F.count(F.lit(1))).scalar()
    return truth.groupBy(label).agg((F.count(F.lit(1)) / n).alias("share"))


def frequency_logloss(pred: DataFrame, truth: DataFrame, shares: DataFrame, label: str = "target",
                      id_col: str = "object_id", eps: float = PROB_EPS) -> DataFrame:
    """M4: the training loss of a batch: mean over the classes of (sum over the class' objects of -log(clip(p)) / batch
    size) / share of the class.  ``shares`` lists all classes (a class without objects in the batch adds 0)."""
    t = truth.select(id_col, F.col(label).cast("int").alias(label))
    n = t.agg(F.count(F.lit(1))).scalar()
    pt = t.join(pred.select(id_col, F.col("class").alias(label), "p"), [id_col, label], "left")
    per = pt.groupBy(label).agg(F.sum(-F.log(clip_prob(F.coalesce(F.col("p"), F.lit(0.0)), eps))).alias("loss"))
    j = shares.select(label, "share").join(per, label, "left")
    return j.agg(F.avg(F.coalesce(F.col("loss"), F.lit(0.0)) / n / F.col("share")).alias("loss"), F.count(F.lit(1)).alias("n_classes"))


def total_score(pred_wide: DataFrame, truth: DataFrame, weights: DataFrame, classes: list[int]) -> DataFrame:
    """M3 over the united predictions of the two domain models."""
    return weighted_logloss(to_long(pred_wide, classes), truth, weights)


def predicted_class(pred: DataFrame, id_col: str = "object_id") -> DataFrame:
    """Argmax class per object (smallest class id on ties)."""
    return pred.groupBy(id_col).agg(
        F.max_by("class", F.struct(F.col("p"), -F.col("class"))).alias("predicted"))


def confusion_matrix(pred: DataFrame, truth: DataFrame, label: str = "target", id_col: str = "object_id",
                     digits: int | None = None) -> DataFrame:
    """(true, predicted) counts, row-normalised share (optionally rounded)."""
    pc = predicted_class(pred, id_col).join(truth.select(id_col, label), id_col, "inner")
    cm = pc.groupBy(label, "predicted").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(label))
    if digits is not None:
        share = F.round(share, digits)
    return cm.withColumn("share", share)


def unknown_class_score(pred: DataFrame, id_col: str = "object_id", mean_value: float = UNKNOWN_MEAN) -> DataFrame:
    """class_99 = mean_value * prod_c(1 - p_c) / mean over objects of that product."""
    prod = pred.groupBy(id_col).agg(F.product(F.lit(1.0) - F.col("p")).alias("_prod"))
    mean_prod = prod.agg(F.avg("_prod")).scalar()
    return prod.select(id_col, (F.lit(mean_value) * safe_div(F.col("_prod"), mean_prod)).alias("class_99"))


def to_wide(pred: DataFrame, classes: list[int], id_col: str = "object_id") -> DataFrame:
    """Long (object_id, class, p) -> wide ``class_<c>`` columns."""
    return pred.groupBy(id_col).agg(*[F.max(F.when(F.col("class") == c, F.col("p"))).alias(f"class_{c}")
                                      for c in classes])


def to_long(wide: DataFrame, classes: list[int], id_col: str = "object_id") -> DataFrame:
    return wide.select(id_col, F.inline(F.array(*[
        F.struct(F.lit(c).alias("class"), F.col(f"class_{c}").alias("p")) for c in classes])))


def domain_union(pred_gal: DataFrame, pred_exgal: DataFrame, id_col: str = "object_id") -> DataFrame:
    """Union of the two domain models' wide predictions; class columns
    missing in one domain become 0; columns ordered by class."""
    u = pred_gal.unionByName(pred_exgal, allowMissingColumns=True).na.fill(0.0)
    return u.select(id_col, *[f"class_{c}" for c in ALL_CLASSES if f"class_{c}" in u.columns])


def ensemble_mean(preds: list[DataFrame], id_col: str = "object_id") -> DataFrame:
    """Mean probability over several models (long form), one groupBy."""
    u = preds[0]
    for p in preds[1:]:
        u = u.unionByName(p)
    return u.groupBy(id_col, "class").agg(F.avg("p").alias("p"))
