"""Registered model queries (rows-only checks: Spark ML fits are not SQL)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import ALL_CLASSES
from ..operators import evaluation as ev
from ..operators import components, models, prep, research, scaling, sequences, stats
from ..sources.adapters import lc_events, lc_lineitem, meta_part
from .catalog import register

K = 5


def _matrix(spark, sf_dir):
    lc, meta = lc_lineitem(spark, sf_dir), meta_part(spark, sf_dir)
    bm = research.basic_meta(meta)
    bt = stats.basic_ts(lc)
    m = meta.select("object_id", "target", "hostgal_specz").join(bm, "object_id", "left").join(bt, "object_id", "left")
    feats = [c for c in m.columns if c not in ("object_id", "target", "hostgal_specz")]
    folds = ev.stratified_folds(meta, "object_id", "target", K, 71).checkpoint(eager=True)
    return m, feats, folds, meta.select("object_id", "target")


@register("cv_scores")
def q_cv_scores(spark, sf_dir):
    """M5-M7 + M3: weighted random forest, 5-fold out-of-fold predictions, score per fold and total."""
    m, feats, folds, truth = _matrix(spark, sf_dir)
    oof, _ = models.cross_validate(m, feats, folds, ALL_CLASSES)
    oof = oof.checkpoint(eager=True)  # scored four times below
    w = ev.class_table(spark)
    per_fold = [ev.weighted_logloss(oof, truth.join(folds.filter(F.col("fold") == f).select("object_id"), "object_id"), w)
                .withColumn("fold", F.lit(f)) for f in range(K)]
    total = ev.weighted_logloss(oof, truth, w).withColumn("fold", F.lit(-1))
    out = total
    for p in per_fold:
        out = out.unionByName(p)
    return out


@register("importance")
def q_importance(spark, sf_dir):
    """M8 / O3: mean feature importance over the fold models, top 20."""
    m, feats, folds, _ = _matrix(spark, sf_dir)
    _, fitted = models.cross_validate(m, feats, folds, ALL_CLASSES)
    return models.feature_importance(fitted, feats, top=20)


@register("random_search")
def q_random_search(spark, sf_dir):
    """Out-of-fold score of seeded random forest settings (three of nine)."""
    m, feats, folds, truth = _matrix(spark, sf_dir)
    space = {"numTrees": [20, 40, 80], "maxDepth": [3, 5, 8]}
    return models.random_search(m, feats, folds, truth, ev.class_table(spark), ALL_CLASSES, space, n=3)


@register("predict_redshift")
def q_predict_redshift(spark, sf_dir):
    """Out-of-fold random-forest estimate of the spectroscopic redshift."""
    m, feats, folds, _ = _matrix(spark, sf_dir)
    feats = [f for f in feats if f not in ("hostgal_specz",)]
    return models.predict_redshift(m, feats, folds)


@register("encode_sequences")
def q_encode_sequences(spark, sf_dir):
    """16-component PCA encoding of each object's scaled multiband sequences, from their long rows."""
    return components.encode_rows(sequences.scaled_rows(lc_events(spark, sf_dir)), k=16)


@register("dense_classifier")
def q_dense_classifier(spark, sf_dir):
    """Class-balanced multilayer perceptron, out-of-fold probabilities of every object."""
    m, feats, folds, _ = _matrix(spark, sf_dir)
    data = m.join(folds.select("object_id", "fold"), "object_id").checkpoint(eager=True)
    out = []
    for f, (scaler, mlp) in sorted(models.train_dense(data, feats, classes=ALL_CLASSES, fold="fold").items()):
        held = scaler.transform(models._assemble(data.filter(F.col("fold") == f), feats))
        pr = mlp.transform(held).select("object_id", models.vector_to_array("probability").alias("_p"))
        out.append(pr.select("object_id", F.inline(F.array(*[
            F.struct(F.lit(c).alias("class"), F.col("_p")[i].alias("p")) for i, c in enumerate(sorted(ALL_CLASSES))]))))
    return prep.union_all(out)


@register("fluxfactor_predicted_z")
def q_fluxfactor_predicted_z(spark, sf_dir):
    """M15 -> F10 -> G14: light curves scaled to the distance of the out-of-fold predicted redshift, then object stats."""
    m, feats, folds, _ = _matrix(spark, sf_dir)
    z = models.predict_redshift(m, [f for f in feats if f != "hostgal_specz"], folds)
    meta = meta_part(spark, sf_dir).join(z, "object_id", "left")
    return scaling.fluxfactor_v2(lc_lineitem(spark, sf_dir), meta, z_col="predict_specz")
