"""Rate-of-change features (G21-G25, G32; windows W1, W2).

``flux_rate`` is the step to the previous point of the (object, band) series (``functions.windows.lag_columns``, which
cuts long series into slices); the per-object features are mergeable aggregates and exact medians.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggspec import split_spec
from ..functions.core import BANDS, safe_div
from ..functions.quantiles import aggregate_with_medians
from ..functions.windows import lag_columns
from .stats import restore_objects

RATE_AGGS = ["min", "max", "mean", "median", "std", "skew"]


SERIES = ["object_id", "passband"]


def flux_rate(lc: DataFrame, max_gap: float = 100.0, value: str = "flux", out: str = "fluxdiff") -> DataFrame:
    """Per (object, band) by time, ``d value / d mjd`` to the previous point.

    Rows with a NULL in any column are dropped first (P9), as is the first point of a series; only steps strictly below
    ``max_gap`` days are kept; a zero time step gives NULL (not inf).  Adds ``<out>`` and ``mjddiff``."""
    lagged = lag_columns(lc.dropna(), SERIES, "mjd", ["mjd", value], "_prev_")
    return (lagged.withColumns({"mjddiff": F.col("mjd") - F.col("_prev_mjd"), "_dv": F.col(value) - F.col(f"_prev_{value}")})
            .drop("_prev_mjd", f"_prev_{value}")
            .filter(F.col("mjddiff").isNotNull() & F.col("_dv").isNotNull() & (F.col("mjddiff") < max_gap))
            .withColumn(out, safe_div("_dv", "mjddiff")).drop("_dv"))


def flux_curvature(lc: DataFrame, max_gap: float = 100.0) -> DataFrame:
    """Difference of consecutive rates along the series (after the
    gap filter, first rate of a series dropped)."""
    rates = lag_columns(flux_rate(lc, max_gap), SERIES, "mjd", ["mjd", "fluxdiff"], "_prev_")
    return (rates.withColumn("fluxdiffdiff", F.col("fluxdiff") - F.col("_prev_fluxdiff"))
            .filter(F.col("_prev_mjd").isNotNull()).drop("_prev_mjd", "_prev_fluxdiff"))


def _diff_exprs(col: str, suffix: str) -> dict:
    mx, mn, mean = (f"{col}_{a}{suffix}" for a in ("max", "min", "mean"))
    return {f"{col}_diff{suffix}": F.expr(f"{mx} - {mn}"), f"{col}_dif2{suffix}": F.expr(f"try_divide({mx} - {mn}, {mean})")}


def _aggregate(rows: DataFrame, parts) -> DataFrame:
    aggs = [x for a, _, _ in parts for x in a]
    medians = {n: m for _, ms, _ in parts for n, m in ms.items()}
    return aggregate_with_medians(rows, ["object_id"], aggs, medians, [n for _, _, names in parts for n in names])


def rate_object_features(rows: DataFrame, col: str, ids: DataFrame | None = None) -> DataFrame:
    """G22 shape: 6 stats of ``col`` on all and on detected rows, diff and dif2 (16 columns)."""
    parts = [split_spec({col: RATE_AGGS}), split_spec({col: RATE_AGGS}, "detected = 1", "_detected1")]
    agg = _aggregate(rows, parts)
    out = agg.withColumns(_diff_exprs(col, "")).withColumns(_diff_exprs(col, "_detected1"))
    return restore_objects(out, ids)


def rate_band_features(rows: DataFrame, col: str, ids: DataFrame | None = None, contrasts: bool = True,
                       base: int = 5, targets=(0, 1, 2, 3, 4)) -> DataFrame:
    """G23 shape: 6 stats x 6 bands, diff/dif2 per band, band-5 contrasts."""
    out = _aggregate(rows, [split_spec({col: RATE_AGGS}, f"passband = {b}", f"_{b}") for b in BANDS])
    for b in BANDS:
        out = out.withColumns(_diff_exprs(col, f"_{b}"))
    if contrasts:
        out = out.withColumns({
            f"{col}_{s}_diff_{base}_{t}": F.expr(f"{col}_{s}_{base} - {col}_{s}_{t}")
            for t in targets for s in ("max", "min", "mean", "median", "diff", "dif2")})
    return restore_objects(out, ids)


def fluxdiff(lc: DataFrame, ids: DataFrame | None = None, max_gap: float = 100.0) -> DataFrame:
    """G22."""
    return rate_object_features(flux_rate(lc, max_gap), "fluxdiff", ids)


def fluxdiff_passband(lc: DataFrame, ids: DataFrame | None = None, max_gap: float = 100.0) -> DataFrame:
    """G23 (78 columns)."""
    return rate_band_features(flux_rate(lc, max_gap), "fluxdiff", ids)


def fluxdiffdiff(lc: DataFrame, ids: DataFrame | None = None, max_gap: float = 100.0) -> DataFrame:
    """G25 (object form, 16 columns)."""
    return rate_object_features(flux_curvature(lc, max_gap), "fluxdiffdiff", ids)


def fluxdiffdiff_passband(lc: DataFrame, ids: DataFrame | None = None, max_gap: float = 100.0) -> DataFrame:
    """G25 (band form, 48 columns, no contrasts)."""
    return rate_band_features(flux_curvature(lc, max_gap), "fluxdiffdiff", ids,
                              contrasts=False)


def mjddiff_passband(lc: DataFrame, ids: DataFrame | None = None, max_gap: float = 100.0) -> DataFrame:
    """Band stats of the rate without contrasts (48 columns)."""
    return rate_band_features(flux_rate(lc, max_gap), "fluxdiff", ids, contrasts=False)
