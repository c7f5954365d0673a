"""Registered evaluation queries (M1-M5, M7, M10-M13, U2): folds, weights,
out-of-fold scoring, confusion matrix, unknown-class score, domain union."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import ALL_CLASSES, GALACTIC_CLASSES
from ..operators import evaluation as ev, prep
from ..session import ensure_checkpoint_dir
from ..sources.adapters import lc_lineitem, meta_part, with_ctes
from .catalog import register
from .sqlgen import rounded

EXGAL_CLASSES = [c for c in ALL_CLASSES if c not in GALACTIC_CLASSES]
FEATURES = ["flux_mean", "flux_std", "hostgal_photoz", "mwebv"]
K, SEED = 5, 71


def _features(spark, sf_dir, with_folds: bool = False):
    """Per-object classifier inputs: lc stats joined onto meta (keyed by object_id)."""
    lc = lc_lineitem(spark, sf_dir)
    meta = meta_part(spark, sf_dir)
    agg = lc.groupBy("object_id").agg(F.avg("flux").alias("flux_mean"), F.stddev_samp("flux").alias("flux_std"))
    f = meta.select("object_id", "target", "hostgal_photoz", "mwebv").join(agg, "object_id", "left")
    if with_folds:
        f = f.join(ev.stratified_folds(meta, "object_id", "target", K, SEED).select("object_id", "fold"),
                   "object_id", "inner")
    return f


def _md5(col: str, seed: int = SEED) -> str:
    return f"md5(CAST({col} AS VARCHAR) || ':{seed}')"


_FOLDS_SQL = (f"SELECT object_id, target, CAST((row_number() OVER (PARTITION BY target ORDER BY {_md5('object_id')}) - 1)"
              f" % {K} AS INTEGER) AS fold FROM meta")
_FEAT_SQL = ("SELECT m.object_id, m.target, m.hostgal_photoz, m.mwebv, a.flux_mean, a.flux_std FROM meta m LEFT JOIN "
             "(SELECT object_id, avg(flux) AS flux_mean, stddev_samp(flux) AS flux_std FROM lc GROUP BY 1) a "
             "ON a.object_id = m.object_id")
_FEATF_SQL = "SELECT f.*, d.fold FROM feat f JOIN folds d ON d.object_id = f.object_id"


def _centroid_ctes(src: str, classes=None, mode: str = "single", prefix: str = "c") -> list[tuple[str, str]]:
    """DuckDB twin of ``centroid_probabilities`` / ``centroid_ensemble``; last CTE ``<prefix>_pred``."""
    st = ", ".join([f"avg({c}) AS {c}_m" for c in FEATURES] + [f"stddev_pop({c}) AS {c}_s" for c in FEATURES])
    if mode == "single":
        st, fold, other = f"SELECT 0 AS f, {st} FROM {src}", "", "TRUE"
    else:   # the model of fold f: standardised and averaged over the rows of the other folds
        st = (f"SELECT r.f, {st} FROM {src} z, (SELECT unnest(range(0, (SELECT max(fold) + 1 FROM {src}))) AS f) r "
              "WHERE r.f != z.fold GROUP BY r.f")
        fold, other = ", fold", "f != fold"
    zf = (f"SELECT object_id, target{fold}, f, "
          + ", ".join(f"coalesce(({c} - {c}_m) / nullif({c}_s, 0), 0) AS {c}" for c in FEATURES)
          + f" FROM {src}, {prefix}_st")
    where = f" AND target IN ({', '.join(map(str, classes))})" if classes else ""
    avgs = ", ".join(f"avg({c}) AS {c}" for c in FEATURES)
    cents = f"SELECT f, target, {avgs} FROM {prefix}_zf WHERE {other}{where} GROUP BY 1, 2"
    join = f"{prefix}_cent c ON c.f = z.f" + (" AND z.f = z.fold" if mode == "oof" else "")
    dist = "0 + " + " + ".join(f"power(z.{c} - c.{c}, 2)" for c in FEATURES)
    sc = f"SELECT z.object_id, c.f AS model, c.target AS cls, -({dist}) AS s FROM {prefix}_zf z JOIN {join}"
    sc2 = f"SELECT *, max(s) OVER (PARTITION BY object_id, model) AS mx FROM {prefix}_sc"
    p = ("SELECT object_id, model, CAST(cls AS INTEGER) AS class, exp(s - mx) / sum(exp(s - mx)) OVER "
         f"(PARTITION BY object_id, model) AS p FROM {prefix}_sc2")
    ctes = [(f"{prefix}_st", st), (f"{prefix}_zf", zf), (f"{prefix}_cent", cents),
            (f"{prefix}_sc", sc), (f"{prefix}_sc2", sc2), (f"{prefix}_p", p)]
    if mode == "ensemble":
        ctes.append((f"{prefix}_pred", f"SELECT object_id, class, avg(p) AS p FROM {prefix}_p GROUP BY 1, 2"))
    else:
        ctes.append((f"{prefix}_pred", f"SELECT object_id, class, p FROM {prefix}_p"))
    return ctes


_BASE = [("feat", _FEAT_SQL), ("folds", _FOLDS_SQL), ("featf", _FEATF_SQL)]
_WEIGHTS_SQL = ("SELECT * FROM (VALUES " + ", ".join(f"({c}, {w})" for c, w in ev.CLASS_WEIGHTS.items())
                + ") t(target, weight)")


def _oof(spark, sf_dir):
    return ev.centroid_probabilities(_features(spark, sf_dir, True), "target", FEATURES, fold_col="fold")


@register("folds", with_ctes("SELECT * FROM folds", meta=True, lc=None, ctes=[("folds", _FOLDS_SQL)]))
def q_folds(spark, sf_dir):
    """M1: stratified 5-fold ids by class, seeded hash order (seed 71)."""
    return ev.stratified_folds(meta_part(spark, sf_dir), "object_id", "target", K, SEED)


@register("kfold", with_ctes(
    f"SELECT object_id, CAST((row_number() OVER (ORDER BY {_md5('object_id')}) - 1) % {K} AS INTEGER) AS fold FROM meta",
    meta=True, lc=None))
def q_kfold(spark, sf_dir):
    """M2: unstratified 5-fold ids."""
    return ev.kfold(meta_part(spark, sf_dir), "object_id", K, SEED)


@register("class_weights", rounded(with_ctes(
    "SELECT c.target, c.n, (SELECT count(*) FROM meta) / c.n AS sample_weight, w.weight / (SELECT sum(weight) FROM wt) "
    "AS weight_norm FROM (SELECT target, count(*) AS n FROM meta GROUP BY target) c LEFT JOIN wt w ON w.target = c.target",
    meta=True, lc=None, ctes=[("wt", _WEIGHTS_SQL)]), keys=("target", "n")))
def q_class_weights(spark, sf_dir):
    """M5: class counts, sample weight N / n_class and normalised metric weights."""
    return ev.class_balance(meta_part(spark, sf_dir).select("object_id", "target"), "target", ev.class_table(spark))


@register("weighted_logloss", rounded(with_ctes(
    "SELECT -sum(w.weight * pc.mean_logp) / sum(w.weight) AS wloss, CAST(sum(pc.n) AS BIGINT) AS n_objects, count(*) AS n_classes "
    "FROM (SELECT t.target, avg(ln(greatest(least(coalesce(p.p, 0), 1 - 1e-15), 1e-15))) AS mean_logp, count(*) AS n "
    "FROM meta t LEFT JOIN c_pred p ON p.object_id = t.object_id AND p.class = t.target GROUP BY t.target) pc "
    "JOIN wt w ON w.target = pc.target", meta=True,
    ctes=_BASE + _centroid_ctes("featf", mode="oof") + [("wt", _WEIGHTS_SQL)]), keys=("n_objects", "n_classes")))
def q_weighted_logloss(spark, sf_dir):
    """M3 + M7: class-weighted multi-class log-loss of out-of-fold predictions."""
    truth = meta_part(spark, sf_dir).select("object_id", "target")
    return ev.weighted_logloss(_oof(spark, sf_dir), truth, ev.class_table(spark))


@register("confusion", rounded(with_ctes(
    "SELECT target, predicted, n, n / sum(n) OVER (PARTITION BY target) AS share FROM (SELECT t.target, a.predicted, "
    "count(*) AS n FROM (SELECT object_id, CAST(arg_max(class, p) AS INTEGER) AS predicted FROM (SELECT object_id, class, "
    "p, row_number() OVER (PARTITION BY object_id ORDER BY p DESC, class ASC) AS rn FROM c_pred) WHERE rn = 1 "
    "GROUP BY object_id) a JOIN meta t ON t.object_id = a.object_id GROUP BY 1, 2)", meta=True,
    ctes=_BASE + _centroid_ctes("featf", mode="oof")), keys=("target", "predicted", "n")))
def q_confusion(spark, sf_dir):
    """Confusion matrix (true x argmax class) of out-of-fold predictions, row shares."""
    truth = meta_part(spark, sf_dir).select("object_id", "target")
    return ev.confusion_matrix(_oof(spark, sf_dir), truth)


@register("unknown_class", rounded(with_ctes(
    "SELECT object_id, 0.18 * pr / (SELECT avg(pr) FROM pp) AS class_99 FROM pp", meta=True,
    ctes=_BASE + _centroid_ctes("featf", mode="oof")
    + [("pp", "SELECT object_id, product(1 - p) AS pr FROM c_pred GROUP BY object_id")])))
def q_unknown_class(spark, sf_dir):
    """class_99 = 0.18 * prod(1 - p_c) / mean over objects of the product."""
    return ev.unknown_class_score(_oof(spark, sf_dir))


def _domain_union_sql() -> str:
    gal = ("SELECT * FROM feat WHERE hostgal_photoz = 0")
    exg = ("SELECT * FROM feat WHERE hostgal_photoz != 0")
    wide_g = ", ".join(f"coalesce(max(p) FILTER (WHERE class = {c}), 0) AS class_{c}" if c in GALACTIC_CLASSES
                       else f"0.0::DOUBLE AS class_{c}" for c in ALL_CLASSES)
    wide_x = ", ".join(f"coalesce(max(p) FILTER (WHERE class = {c}), 0) AS class_{c}" if c not in GALACTIC_CLASSES
                       else f"0.0::DOUBLE AS class_{c}" for c in ALL_CLASSES)
    body = (f"SELECT object_id, {wide_g} FROM g_pred GROUP BY object_id UNION ALL "
            f"SELECT object_id, {wide_x} FROM x_pred GROUP BY object_id")
    return rounded(with_ctes(body, meta=True, ctes=[("feat", _FEAT_SQL), ("gal", gal), ("exg", exg)]
                             + _centroid_ctes("gal", GALACTIC_CLASSES, prefix="g")
                             + _centroid_ctes("exg", EXGAL_CLASSES, prefix="x")))


@register("domain_union", _domain_union_sql())
def q_domain_union(spark, sf_dir):
    """P7 + M10 + U2: separate galactic / extragalactic models, class columns unioned, missing -> 0."""
    f = _features(spark, sf_dir)
    gal = ev.centroid_probabilities(f.filter(F.col("hostgal_photoz") == 0), "target", FEATURES, GALACTIC_CLASSES)
    exg = ev.centroid_probabilities(f.filter(F.col("hostgal_photoz") != 0), "target", FEATURES, EXGAL_CLASSES)
    return ev.domain_union(ev.to_wide(gal, GALACTIC_CLASSES), ev.to_wide(exg, EXGAL_CLASSES))


@register("ensemble", rounded(with_ctes("SELECT object_id, class, p FROM c_pred", meta=True,
                                        ctes=_BASE + _centroid_ctes("featf", mode="ensemble")),
                              keys=("object_id", "class")))
def q_ensemble(spark, sf_dir):
    """Class probabilities averaged over the 5 fold models."""
    return ev.centroid_ensemble(_features(spark, sf_dir, True), "target", FEATURES)


@register("frequency_logloss", rounded(with_ctes(
    "SELECT fold, avg(coalesce(l.loss, 0) / b.size / s.share) AS loss, count(*) AS n_classes FROM "
    "(SELECT target, count(*) / (SELECT count(*) FROM meta) AS share FROM meta GROUP BY target) s CROSS JOIN "
    "(SELECT CAST(fold AS INTEGER) AS fold, count(*) AS size FROM folds GROUP BY 1) b LEFT JOIN "
    "(SELECT t.fold AS f, t.target, sum(-ln(greatest(least(coalesce(p.p, 0), 1 - 1e-15), 1e-15))) AS loss FROM folds t LEFT JOIN c_pred p "
    "ON p.object_id = t.object_id AND p.class = t.target GROUP BY 1, 2) l ON l.target = s.target AND l.f = b.fold GROUP BY fold", meta=True,
    ctes=_BASE + _centroid_ctes("featf", mode="oof")), keys=("fold", "n_classes")))
def q_frequency_logloss(spark, sf_dir):
    """M4: class-frequency-weighted loss of the held-out predictions of every fold, shares from all objects."""
    ensure_checkpoint_dir(spark)
    meta = meta_part(spark, sf_dir)
    folds = ev.stratified_folds(meta, "object_id", "target", K, SEED).checkpoint()
    oof, share = _oof(spark, sf_dir).checkpoint(), ev.class_share(meta.select("object_id", "target"))
    per = [ev.frequency_logloss(oof, folds.filter(F.col("fold") == f).select("object_id", "target"), share).withColumn("fold", F.lit(f)) for f in range(K)]
    return prep.union_all(per)


@register("frequency_logloss_oof", rounded(with_ctes(
    "SELECT avg(coalesce(l.loss, 0) / (SELECT count(*) FROM meta) / s.share) AS loss, count(*) AS n_classes FROM "
    "(SELECT target, count(*) / (SELECT count(*) FROM meta) AS share FROM meta GROUP BY target) s LEFT JOIN "
    "(SELECT t.target, sum(-ln(greatest(least(coalesce(p.p, 0), 1 - 1e-15), 1e-15))) AS loss FROM meta t LEFT JOIN c_pred p "
    "ON p.object_id = t.object_id AND p.class = t.target GROUP BY t.target) l ON l.target = s.target", meta=True,
    ctes=_BASE + _centroid_ctes("featf", mode="oof")), keys=("n_classes",)))
def q_frequency_logloss_oof(spark, sf_dir):
    """M4: class-frequency-weighted loss of the out-of-fold predictions of all objects."""
    truth = meta_part(spark, sf_dir).select("object_id", "target")
    return ev.frequency_logloss(_oof(spark, sf_dir), truth, ev.class_share(truth))


@register("two_domain_score", rounded(with_ctes(
    "SELECT -sum(w.weight * pc.mean_logp) / sum(w.weight) AS wloss, CAST(sum(pc.n) AS BIGINT) AS n_objects, count(*) AS n_classes "
    "FROM (SELECT t.target, avg(ln(greatest(least(coalesce(p.p, 0), 1 - 1e-15), 1e-15))) AS mean_logp, count(*) AS n "
    "FROM meta t LEFT JOIN (SELECT * FROM g_pred UNION ALL SELECT * FROM x_pred) p ON p.object_id = t.object_id AND p.class = t.target "
    "GROUP BY t.target) pc JOIN wt w ON w.target = pc.target", meta=True,
    ctes=_BASE + [("galf", "SELECT * FROM featf WHERE hostgal_photoz = 0"), ("exgf", "SELECT * FROM featf WHERE hostgal_photoz != 0")]
    + _centroid_ctes("galf", GALACTIC_CLASSES, mode="oof", prefix="g") + _centroid_ctes("exgf", EXGAL_CLASSES, mode="oof", prefix="x")
    + [("wt", _WEIGHTS_SQL)]), keys=("n_objects", "n_classes")))
def q_two_domain_score(spark, sf_dir):
    """Total out-of-fold score of the galactic and the extragalactic model together."""
    f = _features(spark, sf_dir, True)
    gal = ev.centroid_probabilities(f.filter(F.col("hostgal_photoz") == 0), "target", FEATURES, GALACTIC_CLASSES, fold_col="fold")
    exg = ev.centroid_probabilities(f.filter(F.col("hostgal_photoz") != 0), "target", FEATURES, EXGAL_CLASSES, fold_col="fold")
    both = ev.domain_union(ev.to_wide(gal, GALACTIC_CLASSES), ev.to_wide(exg, EXGAL_CLASSES))
    return ev.total_score(both, meta_part(spark, sf_dir).select("object_id", "target"), ev.class_table(spark), ALL_CLASSES)
