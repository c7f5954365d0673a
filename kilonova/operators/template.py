"""Template fit (F9, J13), re-aimed: per-class light-curve templates are learned
from the labelled objects (mean of flux / peak flux per band and phase bin
around the peak), then every extragalactic object is fitted against every
(class template, time shift) with the closed-form amplitude
x0 = sum(f m / e^2) / sum(m^2 / e^2).

A candidate answers for all observations of the object: where its template has
no value it predicts 0, so chi2 = sum over all (f / e)^2 - x0 * sum(f m / e^2),
and candidates are ranked by chi2 / (n - 1) with n the object's observations.
Templates are learned out of fold (``object_id`` modulo ``FOLDS``): an object
never meets a template that holds its own points.

The template table has (folds x classes x bands x bins) rows -- fixed by the
parameters; candidates come from an equi-join on (fold, band, phase bin) per
shift, not a cross join.  Ties: smallest class, then shift.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import safe_div, snap
from ..functions.windows import join_back
from .peaks import peak_mjd_expr
from .stats import restore_objects

SHIFTS = [-20.0, -10.0, 0.0, 10.0, 20.0]
FOLDS = 5


def _fold() -> F.Column:
    return F.pmod(F.col("object_id"), F.lit(FOLDS)).cast("int")


def _with_peak(lc: DataFrame) -> DataFrame:
    return join_back(lc, lc.groupBy("object_id").agg(peak_mjd_expr().alias("_peak"), F.max("flux").alias("_pflux")), ["object_id"])


def learn_templates(lc: DataFrame, meta: DataFrame, width: float = 10.0, lo: float = -50.0, hi: float = 150.0,
                    label: str = "target") -> DataFrame:
    """(fold, template, passband, bin, m): mean of flux / peak flux per class, band and phase bin over the objects of
    the other folds (sums per fold, the own fold's subtracted)."""
    nb = int(round((hi - lo) / width))
    rows = _with_peak(lc).join(meta.select("object_id", label), "object_id")
    b = F.floor((F.col("mjd") - F.col("_peak") - lo) / width).cast("int")
    rows = rows.withColumn("bin", b).filter((F.col("bin") >= 0) & (F.col("bin") < nb) & (F.col("_pflux") > 0))
    own = rows.groupBy(_fold().alias("fold"), F.col(label).alias("template"), "passband", "bin").agg(
        F.sum(F.col("flux") / F.col("_pflux")).alias("s"), F.count("flux").alias("n"))
    cell = ["template", "passband", "bin"]
    total = own.groupBy(*cell).agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"),
                                   F.map_from_entries(F.collect_list(F.struct("fold", F.struct("s", "n")))).alias("own"))   # one entry a fold
    every = total.select("*", F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1))).alias("fold"))
    s = F.col("ts") - F.coalesce(F.col("own")[F.col("fold")]["s"], F.lit(0.0))
    n = F.col("tn") - F.coalesce(F.col("own")[F.col("fold")]["n"], F.lit(0))
    return every.select("fold", *cell, safe_div(s, n.cast("double")).alias("m")).filter("m IS NOT NULL")


def template_fit(lc: DataFrame, meta: DataFrame, templates: DataFrame, shifts=SHIFTS, width: float = 10.0,
                 lo: float = -50.0) -> DataFrame:
    """Best (template, shift, x0, chi2) per extragalactic object; n_obs: its observations, n_used: those that the
    template covers.  Galactic objects and objects of fewer than two observations: NULL."""
    exgal = meta.filter(F.col("hostgal_photoz") != 0).select("object_id")
    w2 = F.pow(safe_div(F.lit(1.0), F.col("flux_err")), 2)
    rows = _with_peak(lc.join(exgal, "object_id", "left_semi")).withColumn("w2", w2).filter("w2 IS NOT NULL AND flux IS NOT NULL")
    whole = rows.groupBy("object_id").agg(F.sum(F.col("flux") * F.col("flux") * F.col("w2")).alias("ff"), F.count(F.lit(1)).alias("n_obs"))
    probes = rows.select("object_id", _fold().alias("fold"), "passband", "mjd", "flux", "w2", "_peak",
                         F.explode(F.array(*[F.lit(float(s)) for s in shifts])).alias("shift"))
    probes = probes.withColumn("bin", F.floor((F.col("mjd") - F.col("_peak") - F.col("shift") - lo) / width).cast("int"))
    sums = probes.join(templates, ["fold", "passband", "bin"], "inner").groupBy("object_id", "template", "shift").agg(
        F.sum(F.col("flux") * F.col("m") * F.col("w2")).alias("fm"), F.sum(F.col("m") * F.col("m") * F.col("w2")).alias("mm"),
        F.count(F.lit(1)).alias("n_used"))
    sums = sums.join(whole.filter("n_obs >= 2"), "object_id").withColumn("x0", safe_div("fm", "mm"))
    sums = sums.withColumn("chi2", F.col("ff") - F.coalesce(F.col("x0") * F.col("fm"), F.lit(0.0)))
    sums = sums.withColumn("rchi2", F.col("chi2") / (F.col("n_obs") - 1))
    key = F.struct(-snap("rchi2"), -F.col("template"), -F.col("shift"))
    best = sums.groupBy("object_id").agg(F.max_by(F.struct("template", "shift", "x0", "chi2", "n_used", "n_obs"), key).alias("b"))
    out = best.select("object_id", F.col("b.template").alias("best_template"), F.col("b.shift").alias("best_shift"),
                      F.col("b.x0").alias("x0"), F.col("b.chi2").alias("chi2"), F.col("b.n_used").alias("n_used"),
                      F.col("b.n_obs").alias("n_obs"))
    return restore_objects(out, meta)
