"""Registered per-band series feature queries."""
from __future__ import annotations

from ..functions.core import BAND_LETTERS, BANDS
from ..operators import series
from ..sources.adapters import lc_events, meta_events, with_ctes
from .catalog import register
from .queries_spectral import grid_cte, power_ctes, rows_cte
from .sqlgen import rounded, snap_sql


def _pivot_sql(src: str, names: list[str]) -> str:
    cols = ", ".join(f"max({n}) FILTER (WHERE passband = {b}) AS {n}_{letter}"
                     for n in names for b, letter in zip(BANDS, BAND_LETTERS))
    return (f"SELECT m.object_id, {cols} FROM meta m LEFT JOIN {src} s ON s.object_id = m.object_id "
            f"GROUP BY m.object_id")


def _general_sql() -> str:
    w = "(PARTITION BY object_id, passband)"
    wo = "(PARTITION BY object_id, passband ORDER BY mjd)"
    wmean = (f"sum(flux / nullif(power(flux_err, 2), 0)) OVER {w} / nullif(sum(1 / nullif(power(flux_err, 2), 0)) "
             f"OVER {w}, 0)")
    n = f"CAST(count(flux) OVER {w} AS DOUBLE)"
    base = (f"SELECT *, median(flux) OVER {w} AS med, {wmean} AS wmean, stddev_pop(flux) OVER {w} AS sd, "
            f"max(flux) OVER {w} - min(flux) OVER {w} AS rng, "
            f"abs((flux - lag(flux) OVER {wo}) / nullif(mjd - lag(mjd) OVER {wo}, 0)) AS slope, "
            f"sqrt({n} / nullif({n} - 1, 0)) * ((flux - {wmean}) / nullif(flux_err, 0)) AS delta FROM lc")
    base2 = f"SELECT *, delta * lag(delta) OVER {wo} AS p FROM g0"
    q = {p: f"quantile_cont(flux, {p})" for p in series._PCTS}
    spread = f"({q[0.95]} - {q[0.05]})"
    mids = [f"({q[hi]} - {q[lo]}) / nullif({spread}, 0) AS flux_percentile_ratio_mid{k}"
            for k, (lo, hi) in series._MID.items()]
    agg = ", ".join([
        "(max(flux) - min(flux)) / 2 AS amplitude", *mids, "max(slope) AS max_slope", "max(flux) AS maximum",
        "median(flux) AS median", "median(abs(flux - med)) AS median_absolute_deviation", "min(flux) AS minimum",
        "greatest(abs((max(flux) - median(flux)) / nullif(median(flux), 0)), abs((median(flux) - min(flux)) / "
        "nullif(median(flux), 0))) AS percent_amplitude",
        "CAST(avg(CASE WHEN abs(flux - wmean) > sd THEN 1.0 ELSE 0.0 END) AS DOUBLE) AS percent_beyond_1_std",
        "CAST(avg(CASE WHEN abs(flux - med) < abs(rng * 0.1) THEN 1.0 ELSE 0.0 END) AS DOUBLE) AS percent_close_to_median",
        f"{spread} / nullif(median(flux), 0) AS percent_difference_flux_percentile",
        "CASE WHEN count(flux) >= 3 THEN skewness(flux) * (count(flux) - 2) / sqrt(count(flux) * (count(flux) - 1)) END "
        "AS skew",
        "stddev_pop(flux) AS std", "avg(sign(p) * sqrt(abs(p))) AS stetson_j",
        "avg(abs(delta)) / nullif(sqrt(avg(power(delta, 2))), 0) AS stetson_k", "any_value(wmean) AS weighted_average",
    ])
    long = f"SELECT object_id, passband, {agg} FROM g1 GROUP BY object_id, passband"
    # the damped random walk, point after point
    pts = ("SELECT object_id, passband, V, n, sum(x * x / e) OVER w AS flat, mjd, flux, flux_err, x, e, coalesce(exp((lag(mjd) OVER (PARTITION BY "
           "object_id, passband ORDER BY mjd, flux, flux_err) - mjd) / 100e0), 0e0) AS a FROM (SELECT *, flux - sum(flux / power(flux_err, 2)) OVER w / "
           "sum(1 / power(flux_err, 2)) OVER w AS x, power(flux_err, 2) AS e, var_pop(flux) OVER w AS V, count(*) OVER w AS n FROM lc WHERE flux_err != 0 "
           "WINDOW w AS (PARTITION BY object_id, passband)) WINDOW w AS (PARTITION BY object_id, passband)")
    walk = ("SELECT object_id, passband, any_value(V) AS V, any_value(n) AS n, any_value(flat) AS flat, list({'x': x, 'e': e, 'a': a, 'v': V, 'p': 0e0, "
            "'s': 0e0, 'c': 0e0} ORDER BY mjd, flux, flux_err) AS l FROM pts GROUP BY object_id, passband HAVING any_value(V) > 0 AND any_value(n) > 1")
    pm = "(k.a * k.a * acc.p + k.v * (1 - k.a * k.a))"
    inn = "(k.x - k.a * acc.s)"
    step = (f"{{'x': k.x, 'e': k.e, 'a': k.a, 'v': k.v, 'p': {pm} * k.e / ({pm} + k.e), 's': k.a * acc.s + {pm} / ({pm} + k.e) * {inn}, "
            f"'c': acc.c + {inn} * {inn} / ({pm} + k.e)}}")
    chi = (f"SELECT object_id, passband, n, flat, list_reduce(l, lambda acc, k: {step}, {{'x': 0e0, 'e': 0e0, 'a': 0e0, 'v': V, 'p': V, 's': 0e0, "
           "'c': 0e0}).c AS chi2 FROM walk")
    peak = ("SELECT object_id, passband, 1 / freq AS period_fast FROM (SELECT *, row_number() OVER (PARTITION BY object_id, passband ORDER BY "
            f"{snap_sql('power')} DESC, freq) AS rn FROM pw WHERE power IS NOT NULL) WHERE rn = 1")
    all_ = ("SELECT g.*, p.period_fast, ln(c.chi2 / (c.n - 1)) AS qso_log_chi2_qsonu, ln(c.flat / c.chi2) AS qso_log_chi2nuNULL_chi2nu FROM glong0 g "
            "LEFT JOIN chi c USING (object_id, passband) LEFT JOIN peak p USING (object_id, passband)")
    return rounded(with_ctes(_pivot_sql("glong", series.GENERAL), lc="events", meta=True, ctes=[
        ("g0", base), ("g1", base2), ("glong0", long), ("pts", pts), ("walk", walk), ("chi", chi), grid_cte(), rows_cte(), *power_ctes("wrows"),
        ("peak", peak), ("glong", all_)]))


def _cadence_sql() -> str:
    wo = "(PARTITION BY object_id, passband ORDER BY mjd)"
    base = (f"SELECT *, mjd - lag(mjd) OVER {wo} AS cad, (lead(mjd) OVER {wo} - lag(mjd) OVER {wo}) / "
            f"nullif(mjd - lag(mjd) OVER {wo}, 0) AS d2 FROM lc")
    probs = [f"CAST(avg(CASE WHEN cad IS NULL THEN NULL WHEN cad < {m / 1440.0!r} THEN 1.0 ELSE 0.0 END) AS DOUBLE) "
             f"AS cad_probs_{m}" for m in series.CAD_PROB_MINUTES]
    agg = ", ".join(["avg(d2) AS avg_double_to_single_step", "avg(flux_err) AS avg_err", "avg(mjd) AS avgt", *probs,
                     "avg(cad) AS cads_avg", "median(cad) AS cads_med", "stddev_pop(cad) AS cads_std",
                     "avg(flux) AS mean", "median(d2) AS med_double_to_single_step", "median(flux_err) AS med_err",
                     "CAST(count(*) AS DOUBLE) AS n_epochs", "stddev_pop(d2) AS std_double_to_single_step",
                     "stddev_pop(flux_err) AS std_err", "max(mjd) - min(mjd) AS total_time"])
    long = f"SELECT object_id, passband, {agg} FROM c0 GROUP BY object_id, passband"
    return rounded(with_ctes(_pivot_sql("clong", series.CADENCE), lc="events", meta=True,
                             ctes=[("c0", base), ("clong", long)]))


@register("series_general", _general_sql())
def q_series_general(spark, sf_dir):
    """General per-band series features (138 columns)."""
    return series.series_general(lc_events(spark, sf_dir), meta_events(spark, sf_dir))


@register("series_cadence", _cadence_sql())
def q_series_cadence(spark, sf_dir):
    """Cadence per-band features (192 columns)."""
    return series.series_cadence(lc_events(spark, sf_dir), meta_events(spark, sf_dir))
