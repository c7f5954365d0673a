"""Per-object and per-band statistics (G1-G9, G10-G14 compositions).

Design: every feature set is ONE ``groupBy("object_id")`` with conditional
aggregates (detected rows, one band, ...).  Partial aggregation runs before
the shuffle, so an object with a huge number of rows is pre-reduced on the map
side; the only holistic aggregate is the exact ``median``, which large tables
take from value slices (``functions.quantiles``).  Band pivots are conditional aggregates too, so no
second shuffle and no ``pivot`` value scan is needed.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggspec import compile_aggs, split_spec
from ..functions.core import BANDS, safe_div
from ..functions.quantiles import aggregate_with_medians

# Aggregate specs (fixed feature definitions).
OBJECT_SPEC = {
    "flux": ["min", "max", "mean", "median", "std", "skew"],
    "flux_err": ["min", "max", "mean", "median", "std", "skew"],
    "detected": ["mean"],
    "flux_ratio_sq": ["sum", "skew"],
    "flux_by_flux_ratio_sq": ["sum", "skew"],
}
OBJECT_SPEC_NO_DETECTED = {k: v for k, v in OBJECT_SPEC.items() if k != "detected"}
BAND_SPEC = {
    "flux": ["min", "max", "mean"],
    "flux_ratio_sq": ["sum"],
    "flux_by_flux_ratio_sq": ["sum"],
}
CONTRAST_BASE = 5
CONTRAST_TARGETS = [0, 1, 2, 3, 4]


def with_ratio_columns(lc: DataFrame) -> DataFrame:
    """flux_ratio_sq = (flux / flux_err)^2 and flux_by_flux_ratio_sq = flux * that."""
    r2 = F.pow(safe_div("flux", "flux_err"), 2.0)
    return lc.withColumns({"flux_ratio_sq": r2, "flux_by_flux_ratio_sq": F.col("flux") * r2})


def ratio_exprs(suffix: str = "") -> dict[str, Column]:
    """Diff, dif2, w_mean, dif3 from already aggregated columns (SQL text)."""
    mx, mn, mean = (f"flux_{a}{suffix}" for a in ("max", "min", "mean"))
    w_mean = f"try_divide(flux_by_flux_ratio_sq_sum{suffix}, flux_ratio_sq_sum{suffix})"
    return {
        f"flux_diff{suffix}": F.expr(f"{mx} - {mn}"),
        f"flux_dif2{suffix}": F.expr(f"try_divide({mx} - {mn}, {mean})"),
        f"flux_w_mean{suffix}": F.expr(w_mean),
        f"flux_dif3{suffix}": F.expr(f"try_divide({mx} - {mn}, {w_mean})"),
    }


def object_aggregate(rows: DataFrame, spec=OBJECT_SPEC, detected_variant: bool = True, detected_span: bool = True,
                     drop=("detected_mean_detected1",)) -> DataFrame:
    """G1-G3 per object, columns in the order of the spec."""
    aggs, medians, names = split_spec(spec)
    if detected_span:
        aggs.append(F.expr("max(CASE WHEN detected = 1 THEN mjd END) - min(CASE WHEN detected = 1 THEN mjd END) "
                           "AS diff_mjd_maxmin_detected1"))
        names.append("diff_mjd_maxmin_detected1")
    if detected_variant:
        more = split_spec(spec, "detected = 1", "_detected1", set(drop) & {"detected_mean_detected1"})
        aggs, medians, names = aggs + more[0], medians | more[1], names + more[2]
    return aggregate_with_medians(rows, ["object_id"], aggs, medians, names)


def restore_objects(features: DataFrame, ids: DataFrame | None) -> DataFrame:
    """One output row per object of ``ids`` (objects without rows get NULLs).

    ``ids`` is the per-object dimension; both sides are keyed by object_id so
    the join is a co-partitioned sort-merge join (or a broadcast when Spark's
    size estimate says ``ids`` is small).
    """
    if ids is None:
        return features
    return ids.select("object_id").join(features, "object_id", "left")


def basic_ts(lc: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """G5 = G1 + G2 + G3 + G4 (42 feature columns)."""
    agg = object_aggregate(with_ratio_columns(lc))
    out = agg.withColumns(ratio_exprs("")).withColumns(ratio_exprs("_detected1"))
    return restore_objects(out, meta)


def object_stats(lc: DataFrame, meta: DataFrame | None = None, detected: bool = True,
                 detected_variant: bool = True, drop=("detected_mean_detected1",),
                 detected_span: bool = False) -> DataFrame:
    """G1/G2/G4 family with switches (used by the fluxfactor / maxpoint sets)."""
    spec = OBJECT_SPEC if detected else OBJECT_SPEC_NO_DETECTED
    agg = object_aggregate(with_ratio_columns(lc), spec, detected_variant, detected_span, drop)
    out = agg.withColumns(ratio_exprs(""))
    if detected_variant:
        out = out.withColumns(ratio_exprs("_detected1"))
    kept = [c for c in out.columns if c not in set(drop)]
    return restore_objects(out.select(*kept), meta)


def band_stats_aggs(spec=BAND_SPEC, bands=BANDS) -> list[Column]:
    aggs = []
    for b in bands:
        aggs += compile_aggs(spec, cond=f"passband = {b}", suffix=f"_{b}")
    return aggs


def band_ratio_exprs(bands=BANDS) -> dict[str, Column]:
    out = {}
    for b in bands:
        out.update(ratio_exprs(f"_{b}"))
    return out


def band_contrast_exprs(stats=("max", "min", "mean", "diff", "dif2", "w_mean", "dif3"),
                        base: int = CONTRAST_BASE, targets=CONTRAST_TARGETS) -> dict[str, Column]:
    """Band ``base`` minus each target band, ``flux_<stat>_diff_<base>_<t>``."""
    out = {}
    for t in targets:
        for s in stats:
            out[f"flux_{s}_diff_{base}_{t}"] = F.expr(f"flux_{s}_{base} - flux_{s}_{t}")
    return out


def band_features(lc: DataFrame, meta: DataFrame | None = None, contrasts: bool = True,
                  drop_stats=("min", "max", "mean", "diff")) -> DataFrame:
    """G6 + G7 (+ G8) with per-band columns ``<col>_<agg>_<band>``.

    ``drop_stats`` removes ``flux_<stat>_<band>`` after the contrasts are built.
    """
    agg = with_ratio_columns(lc).groupBy("object_id").agg(*band_stats_aggs())
    out = agg.withColumns(band_ratio_exprs())
    if contrasts:
        out = out.withColumns(band_contrast_exprs())
    dropped = {f"flux_{s}_{b}" for s in drop_stats for b in BANDS}
    out = out.select(*[c for c in out.columns if c not in dropped])
    return restore_objects(out, meta)


def basic_ts_passband(lc: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """Band stats, ratios and band-5 contrasts; min/max/mean/diff per band dropped (65 columns)."""
    return band_features(lc, meta, contrasts=True)
