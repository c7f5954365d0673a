"""Per-band series features (C1-C13 general set; C16-C20 cadence set),
re-aimed from a per-object Python library as native Spark aggregates.

Values of a whole series (weighted mean, median, spread) are mergeable aggregates and exact quantiles joined back on
(object, band); steps come from ``functions.windows`` (long series are cut into slices).  The long result is pivoted to
``<feature>_<band>`` columns by a conditional ``first`` per band.

x = flux, e = flux_err, t = mjd.  ``log_scaled`` converts magnitudes with
10^(-0.4 x) for the amplitude-ratio features (off: flux here is linear).
Pairwise-lag histograms (all pairs of a series) are not built -- see README.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import BAND_LETTERS, BANDS, safe_div
from ..functions.quantiles import aggregate_with_medians, exact_quantiles, key_values_with_medians
from ..functions.windows import join_back, lag_columns
from .stats import restore_objects
from .walk import walk_fit

# Fixed parameters of the cadence features: step lengths in minutes.
CAD_PROB_MINUTES = [1, 10, 20, 30, 40, 50, 100, 500, 1000, 5000, 10000, 50000, 100000, 500000, 1000000,
                    5000000, 10000000]
# Percentiles needed by the general set (fractions).
_PCTS = [0.05, 0.1, 0.175, 0.25, 0.325, 0.4, 0.5, 0.6, 0.675, 0.75, 0.825, 0.9, 0.95]
_MID = {20: (0.4, 0.6), 35: (0.325, 0.675), 50: (0.25, 0.75), 65: (0.175, 0.825), 80: (0.1, 0.9)}

# Fixed names that must equal the reference's for right results.
GENERAL = ["amplitude", "flux_percentile_ratio_mid20", "flux_percentile_ratio_mid35", "flux_percentile_ratio_mid50",
           "flux_percentile_ratio_mid65", "flux_percentile_ratio_mid80", "max_slope", "maximum", "median",
           "median_absolute_deviation", "minimum", "percent_amplitude", "percent_beyond_1_std",
           "percent_close_to_median", "percent_difference_flux_percentile", "period_fast", "qso_log_chi2_qsonu",
           "qso_log_chi2nuNULL_chi2nu", "skew", "std", "stetson_j", "stetson_k", "weighted_average"]
CADENCE = (["avg_double_to_single_step", "avg_err", "avgt"] + [f"cad_probs_{m}" for m in CAD_PROB_MINUTES]
           + ["cads_avg", "cads_med", "cads_std", "mean", "med_double_to_single_step", "med_err", "n_epochs",
              "std_double_to_single_step", "std_err", "total_time"])


def _pivot_bands(long: DataFrame, names: list[str]) -> DataFrame:
    """(object_id, passband, f1..fn) -> object_id, f1_u .. fn_y (one aggregate of at most six rows an object)."""
    # six aggregates of a struct of features, not one for each column
    by_band = long.select("object_id", "passband", F.struct(*names).alias("s")).groupBy("object_id").agg(
        *[F.expr(f"first(CASE WHEN passband = {b} THEN s END, true) AS s{b}") for b in BANDS])
    return by_band.select("object_id", *[F.col(f"s{b}")[n].alias(f"{n}_{letter}") for n in names for b, letter in zip(BANDS, BAND_LETTERS)])


SERIES = ["object_id", "passband"]


def _series_rows(lc: DataFrame, log_scaled: bool) -> DataFrame:
    x = F.pow(F.lit(10.0), F.lit(-0.4) * F.col("flux")) if log_scaled else F.col("flux")
    return lc.select("object_id", "passband", "mjd", "flux", "flux_err", x.alias("_lin"))


def series_general_long(lc: DataFrame, log_scaled: bool = False) -> DataFrame:
    """C1-C13 per (object, band), long form."""
    from .frequency import periodogram_peaks   # built on the series keys of this module

    rows = _series_rows(lc, log_scaled)
    inv = "try_divide(1D, pow(flux_err, 2))"
    sums = key_values_with_medians(rows.withColumn("_inv", F.expr(inv)), SERIES, {
        "_wx": F.sum(F.expr("flux * _inv")), "_w": F.sum("_inv"), "_std": F.stddev_pop("flux"), "_max": F.max("flux"), "_min": F.min("flux"),
        "_n": F.count("flux")}, {"_med": "flux"})
    rows = sums.withColumns({"_wmean": safe_div("_wx", "_w"), "_rng": F.col("_max") - F.col("_min"), "_n": F.col("_n").cast("double")})
    rows = rows.withColumn("_delta", F.sqrt(safe_div(F.col("_n"), F.col("_n") - 1)) * safe_div(F.col("flux") - F.col("_wmean"), F.col("flux_err")))
    rows = lag_columns(rows, SERIES, "mjd", ["mjd", "flux", "_delta"], "_prev_")
    rows = rows.withColumns({
        "_slope": F.abs(safe_div(F.col("flux") - F.col("_prev_flux"), F.col("mjd") - F.col("_prev_mjd"))),
        "_p": F.col("_delta") * F.col("_prev__delta"),
    })
    agg = aggregate_with_medians(rows, SERIES, [
        ((F.max("flux") - F.min("flux")) / 2).alias("amplitude"),
        F.max("_slope").alias("max_slope"),
        F.max("flux").alias("maximum"),
        F.min("flux").alias("minimum"),
        F.max("_lin").alias("_lmax"), F.min("_lin").alias("_lmin"),
        F.avg(F.when(F.abs(F.col("flux") - F.col("_wmean")) > F.col("_std"), 1.0).otherwise(0.0))
        .alias("percent_beyond_1_std"),
        F.avg(F.when(F.abs(F.col("flux") - F.col("_med")) < F.abs(F.col("_rng") * 0.1), 1.0).otherwise(0.0))
        .alias("percent_close_to_median"),
        F.when(F.count("flux") >= 3, F.skewness("flux")).alias("skew"),
        F.stddev_pop("flux").alias("std"),
        F.avg(F.signum("_p") * F.sqrt(F.abs("_p"))).alias("stetson_j"),
        safe_div(F.avg(F.abs("_delta")), F.sqrt(F.avg(F.pow("_delta", 2)))).alias("stetson_k"),
        F.max("_wmean").alias("weighted_average"),
    ], {"median": ("flux", None), "median_absolute_deviation": ("abs(flux - _med)", None), "_lmed": ("_lin", None)})
    pct = exact_quantiles(rows, SERIES, "_lin", _PCTS)
    agg = join_back(agg, pct.select(*SERIES, F.array(*[F.col(f"_q{i}") for i in range(len(_PCTS))]).alias("_pct")), SERIES)
    idx = {p: i for i, p in enumerate(_PCTS)}

    def pc(p: float) -> Column:
        return F.col("_pct")[idx[p]]

    spread = pc(0.95) - pc(0.05)
    cols = {f"flux_percentile_ratio_mid{k}": safe_div(pc(hi) - pc(lo), spread) for k, (lo, hi) in _MID.items()}
    cols["percent_amplitude"] = F.greatest(F.abs(safe_div(F.col("_lmax") - F.col("_lmed"), F.col("_lmed"))),
                                           F.abs(safe_div(F.col("_lmed") - F.col("_lmin"), F.col("_lmed"))))
    cols["percent_difference_flux_percentile"] = safe_div(spread, F.col("_lmed"))
    agg = join_back(agg.withColumns(cols), walk_fit(lc), SERIES)
    agg = join_back(agg, periodogram_peaks(lc).select(*SERIES, "period_fast"), SERIES)
    return agg.select("object_id", "passband", *GENERAL)


def series_general(lc: DataFrame, ids: DataFrame | None = None, log_scaled: bool = False) -> DataFrame:
    """General set, 23 features x 6 bands = 138 columns ``<feature>_<u..y>``."""
    return restore_objects(_pivot_bands(series_general_long(lc, log_scaled), GENERAL), ids)


def series_cadence_long(lc: DataFrame) -> DataFrame:
    """C16-C20 per (object, band), long form."""
    rows = lag_columns(_series_rows(lc, False), SERIES, "mjd", ["mjd"], "_p1_")     # previous point
    rows = lag_columns(rows, SERIES, "mjd", ["_p1_mjd"], "_p2")                       # and the one before
    # step to the previous point; (t[i] - t[i-2]) / (t[i-1] - t[i-2]): two steps over the first of them
    rows = rows.withColumns({"_cad": F.col("mjd") - F.col("_p1_mjd"),
                             "_d2": safe_div(F.col("mjd") - F.col("_p2_p1_mjd"), F.col("_p1_mjd") - F.col("_p2_p1_mjd"))})
    aggs = [
        F.avg("_d2").alias("avg_double_to_single_step"),
        F.avg("flux_err").alias("avg_err"),
        F.avg("mjd").alias("avgt"),
    ]
    aggs += [F.avg(F.when(F.col("_cad").isNull(), None)
                   .when(F.col("_cad") < F.lit(m / 1440.0), 1.0).otherwise(0.0)).alias(f"cad_probs_{m}")
             for m in CAD_PROB_MINUTES]
    aggs += [
        F.avg("_cad").alias("cads_avg"), F.stddev_pop("_cad").alias("cads_std"),
        F.avg("flux").alias("mean"), F.count(F.lit(1)).cast("double").alias("n_epochs"),
        F.stddev_pop("_d2").alias("std_double_to_single_step"), F.stddev_pop("flux_err").alias("std_err"),
        (F.max("mjd") - F.min("mjd")).alias("total_time"),
    ]
    medians = {"cads_med": ("_cad", None), "med_double_to_single_step": ("_d2", None), "med_err": ("flux_err", None)}
    return aggregate_with_medians(rows, SERIES, aggs, medians).select("object_id", "passband", *CADENCE)


def series_cadence(lc: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Cadence set, 32 features x 6 bands = 192 columns."""
    return restore_objects(_pivot_bands(series_cadence_long(lc), CADENCE), ids)
