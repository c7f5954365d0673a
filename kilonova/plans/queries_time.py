"""Registered rate, bucket and timing queries."""
from __future__ import annotations

import itertools

from ..functions.core import BANDS
from ..operators import buckets, rates, timing
from ..sources.adapters import lc_events, lc_lineitem, meta_events, meta_part, with_ctes
from .catalog import register
from .sqlgen import agg_sql, rounded


def _ev(spark, sf_dir):
    return lc_events(spark, sf_dir), meta_events(spark, sf_dir)


def _restore(body: str, cols: str = "f.* EXCLUDE (object_id)") -> str:
    return f"SELECT m.object_id, {cols} FROM meta m LEFT JOIN ({body}) f ON f.object_id = m.object_id"


# ---------------------------------------------------------------- rates

def _rate_cte(src="lc", max_gap=100.0):
    return [
        ("r0", f"SELECT *, mjd - lag(mjd) OVER w AS mjddiff, flux - lag(flux) OVER w AS dv FROM {src} "
               "WINDOW w AS (PARTITION BY object_id, passband ORDER BY mjd)"),
        ("rates", f"SELECT object_id, mjd, passband, detected, mjddiff, dv / nullif(mjddiff, 0) AS fluxdiff FROM r0 "
                  f"WHERE mjddiff IS NOT NULL AND dv IS NOT NULL AND mjddiff < {max_gap}"),
    ]


_CURV_CTE = [("c0", "SELECT *, fluxdiff - lag(fluxdiff) OVER w AS fluxdiffdiff, lag(mjd) OVER w AS pm FROM rates "
                    "WINDOW w AS (PARTITION BY object_id, passband ORDER BY mjd)"),
             ("curv", "SELECT * FROM c0 WHERE pm IS NOT NULL")]


def _rate_object_sql(src: str, col: str) -> str:
    spec = {col: rates.RATE_AGGS}
    aggs = agg_sql(spec) + agg_sql(spec, where="detected = 1", suffix="_detected1")
    inner = f"SELECT object_id, {', '.join(aggs)} FROM {src} GROUP BY object_id"
    extra = []
    for s in ("", "_detected1"):
        extra += [f"{col}_max{s} - {col}_min{s} AS {col}_diff{s}",
                  f"({col}_max{s} - {col}_min{s}) / nullif({col}_mean{s}, 0) AS {col}_dif2{s}"]
    return _restore(f"SELECT *, {', '.join(extra)} FROM ({inner})")


def _rate_band_sql(src: str, col: str, contrasts: bool) -> str:
    spec = {col: rates.RATE_AGGS}
    aggs = []
    for b in BANDS:
        aggs += agg_sql(spec, where=f"passband = {b}", suffix=f"_{b}")
    inner = f"SELECT object_id, {', '.join(aggs)} FROM {src} GROUP BY object_id"
    extra = []
    for b in BANDS:
        extra += [f"{col}_max_{b} - {col}_min_{b} AS {col}_diff_{b}",
                  f"({col}_max_{b} - {col}_min_{b}) / nullif({col}_mean_{b}, 0) AS {col}_dif2_{b}"]
    step1 = f"SELECT *, {', '.join(extra)} FROM ({inner})"
    if contrasts:
        con = [f"{col}_{s}_5 - {col}_{s}_{t} AS {col}_{s}_diff_5_{t}"
               for t in (0, 1, 2, 3, 4) for s in ("max", "min", "mean", "median", "diff", "dif2")]
        step1 = f"SELECT *, {', '.join(con)} FROM ({step1})"
    return _restore(step1)


def _evq(body, ctes=()):
    return rounded(with_ctes(body, lc="events", meta=True, ctes=list(ctes)))


@register("fluxdiff", _evq(_rate_object_sql("rates", "fluxdiff"), _rate_cte()))
def q_fluxdiff(spark, sf_dir):
    """G21 + G22: stats of the flux rate per object."""
    return rates.fluxdiff(*_ev(spark, sf_dir))


@register("fluxdiff_passband", _evq(_rate_band_sql("rates", "fluxdiff", True), _rate_cte()))
def q_fluxdiff_passband(spark, sf_dir):
    """Per-band stats of the flux rate with band-5 contrasts."""
    return rates.fluxdiff_passband(*_ev(spark, sf_dir))


@register("fluxdiffdiff", _evq(_rate_object_sql("curv", "fluxdiffdiff"), _rate_cte() + _CURV_CTE))
def q_fluxdiffdiff(spark, sf_dir):
    """G24 + G25: stats of the change of rate."""
    return rates.fluxdiffdiff(*_ev(spark, sf_dir))


@register("fluxdiffdiff_passband", _evq(_rate_band_sql("curv", "fluxdiffdiff", False), _rate_cte() + _CURV_CTE))
def q_fluxdiffdiff_passband(spark, sf_dir):
    """G25 (band form)."""
    return rates.fluxdiffdiff_passband(*_ev(spark, sf_dir))


@register("mjddiff_passband", _evq(_rate_band_sql("rates", "fluxdiff", False), _rate_cte()))
def q_mjddiff_passband(spark, sf_dir):
    """Per-band rate stats without contrasts."""
    return rates.mjddiff_passband(*_ev(spark, sf_dir))


# ---------------------------------------------------------------- buckets

def _timegrouper_sql(width=14.0) -> str:
    band_aggs = []
    for b in BANDS:
        band_aggs += [f"avg(flux) FILTER (WHERE passband = {b}) AS flux_{b}",
                      f"avg(flux_err) FILTER (WHERE passband = {b}) AS flux_err_{b}"]
    p = f"SELECT object_id, CAST(floor(mjd / {width}) AS BIGINT) AS bucket, {', '.join(band_aggs)} FROM lc GROUP BY 1, 2"
    unions = " UNION ALL ".join(
        f"SELECT object_id, bucket, '{t}_{b}' AS pair, flux_{t} - flux_{b} AS flux, "
        f"sqrt(power(flux_err_{t}, 2) + power(flux_err_{b}, 2)) AS flux_err FROM tg_p"
        for b, t in buckets.BAND_PAIRS)
    r = ("SELECT *, power(flux / nullif(flux_err, 0), 2) AS flux_ratio_sq, "
         "flux * power(flux / nullif(flux_err, 0), 2) AS flux_by_flux_ratio_sq FROM tg_l")
    spec = {c: buckets.BUCKET_AGGS for c in buckets.PAIR_COLS}
    a = f"SELECT object_id, pair, {', '.join(agg_sql(spec))} FROM tg_r GROUP BY 1, 2"
    d = ("SELECT *, flux_max - flux_min AS diff, (flux_max - flux_min) / nullif(flux_mean, 0) AS dif2, "
         "flux_by_flux_ratio_sq_sum / nullif(flux_ratio_sq_sum, 0) AS w_mean, "
         "(flux_max - flux_min) / nullif(flux_by_flux_ratio_sq_sum / nullif(flux_ratio_sq_sum, 0), 0) AS dif3 "
         "FROM tg_a")
    outs = []
    for pn in buckets.PAIR_NAMES:
        for c in buckets.PAIR_COLS:
            for ag in buckets.BUCKET_AGGS:
                outs.append(f"max({c}_{ag}) FILTER (WHERE pair = '{pn}') AS {c}_{pn}_{ag}")
        for dn in ("diff", "dif2", "w_mean", "dif3"):
            outs.append(f"max({dn}) FILTER (WHERE pair = '{pn}') AS flux_{dn}_{pn}")
    body = (f"SELECT m.object_id, {', '.join(outs)} FROM meta m LEFT JOIN tg_d d ON d.object_id = m.object_id "
            f"GROUP BY m.object_id")
    return rounded(with_ctes(body, lc="lineitem", meta=True,
                             ctes=[("tg_p", p), ("tg_l", unions), ("tg_r", r), ("tg_a", a), ("tg_d", d)]))


@register("timegrouper", _timegrouper_sql())
def q_timegrouper(spark, sf_dir):
    """14-day bucket band-pair differences aggregated per object (480 columns)."""
    return buckets.timegrouper(lc_lineitem(spark, sf_dir), meta_part(spark, sf_dir), width_days=14.0)


_COVERAGE_WIDTHS = (0.25, 1.0, 3.0, 5.0, 7.0, 14.0, 30.0)


def _coverage_sql() -> str:
    ws = ", ".join(str(w) for w in _COVERAGE_WIDTHS)
    body = (f"SELECT width_days, count(*) AS n_buckets, avg(CASE WHEN band_mask = 63 THEN 1.0 ELSE 0.0 END)::DOUBLE "
            f"AS complete_share FROM (SELECT w.width_days, object_id, CAST(floor(mjd / w.width_days) AS BIGINT) AS b, "
            f"bit_or(1 << passband) AS band_mask FROM lc, (SELECT unnest([{ws}])::DOUBLE AS width_days) w "
            f"GROUP BY 1, 2, 3) GROUP BY width_days")
    return rounded(with_ctes(body, lc="events"), keys=("n_buckets",))


@register("bucket_coverage", _coverage_sql())
def q_bucket_coverage(spark, sf_dir):
    """Per bucket width, number of (object, bucket) cells and share with all 6 bands."""
    return buckets.bucket_coverage(lc_events(spark, sf_dir), widths=_COVERAGE_WIDTHS)


# ---------------------------------------------------------------- timing

def _taq_sql() -> str:
    qcols = ", ".join(f"quantile_cont(flux, {q}) OVER (PARTITION BY object_id) AS q{i}"
                      for i, q in enumerate(timing.QUANTILES))
    aggs = ", ".join(f"max(mjd) FILTER (WHERE flux > q{i}) - min(mjd) FILTER (WHERE flux > q{i}) "
                     f"AS mjd_diff_{timing._num(q)}" for i, q in enumerate(timing.QUANTILES))
    return _evq(_restore(f"SELECT object_id, {aggs} FROM taq GROUP BY object_id"),
                [("taq", f"SELECT *, {qcols} FROM lc")])


@register("time_above_quantile", _taq_sql())
def q_time_above_quantile(spark, sf_dir):
    """Time span of rows above each flux quantile."""
    return timing.time_above_quantile(*_ev(spark, sf_dir))


def _taa_sql() -> str:
    aggs = ", ".join(f"max(mjd) FILTER (WHERE flux > amp * {f}) - min(mjd) FILTER (WHERE flux > amp * {f}) "
                     f"AS mjd_diff_amp_{timing._num(f)}" for f in timing.AMPLITUDE_FRACTIONS)
    return _evq(_restore(f"SELECT object_id, {aggs} FROM taa GROUP BY object_id"),
                [("taa", "SELECT *, max(flux) OVER (PARTITION BY object_id) - min(flux) OVER (PARTITION BY object_id) "
                         "AS amp FROM lc")])


@register("time_above_amplitude", _taa_sql())
def q_time_above_amplitude(spark, sf_dir):
    """Time span of rows above fractions of the amplitude."""
    return timing.time_above_amplitude(*_ev(spark, sf_dir))


def _tfp_sql() -> str:
    w = "(PARTITION BY object_id, passband)"
    base = (f"SELECT *, first_value(mjd) OVER (PARTITION BY object_id, passband ORDER BY flux DESC, mjd ASC) AS peak, "
            f"max(flux) OVER {w} AS fmax, min(flux) OVER {w} AS fmin FROM lc WHERE detected = 1")
    aggs, outs = [], []
    for b in BANDS:
        aggs.append(f"max(peak) FILTER (WHERE passband = {b}) AS peak_{b}")
        for which in ("after", "before"):
            for p in timing.PEAK_LEVELS:
                cond = f"passband = {b} AND flux < fmin + (fmax - fmin) * {p}"
                n = f"{which}_{timing._num(p)}_{b}"
                if which == "after":
                    aggs.append(f"min(mjd) FILTER (WHERE {cond} AND mjd > peak) AS {n}")
                    outs.append(f"{n} - peak_{b} AS time_from_peak_after_thres{timing._num(p)}_pass{b}")
                else:
                    aggs.append(f"max(mjd) FILTER (WHERE {cond} AND mjd < peak) AS {n}")
                    outs.append(f"peak_{b} - {n} AS time_from_peak_before_thres{timing._num(p)}_pass{b}")
    inner = f"SELECT object_id, {', '.join(aggs)} FROM tfp GROUP BY object_id"
    return _evq(_restore(f"SELECT object_id, {', '.join(outs)} FROM ({inner})"), [("tfp", base)])


@register("time_from_peak", _tfp_sql())
def q_time_from_peak(spark, sf_dir):
    """Time from the band peak to the flux falling below 10..90% levels."""
    return timing.time_from_peak(*_ev(spark, sf_dir))


def _diff_peak_sql() -> str:
    base = ("SELECT object_id, passband, mjd, row_number() OVER (PARTITION BY object_id, passband "
            "ORDER BY flux DESC, mjd ASC) AS rn FROM lc WHERE detected = 1")
    piv = ", ".join(f"max(mjd) FILTER (WHERE passband = {b}) AS pass{b}" for b in BANDS)
    pairs = ", ".join(f"pass{a} - pass{b} AS peakpoint_pass{a}_pass{b}" for a, b in itertools.combinations(BANDS, 2))
    inner = f"SELECT object_id, {pairs} FROM (SELECT object_id, {piv} FROM dp WHERE rn = 1 GROUP BY object_id)"
    return _evq(_restore(inner), [("dp", base)])


@register("diff_peak", _diff_peak_sql())
def q_diff_peak(spark, sf_dir):
    """Differences of the per-band peak times for the 15 band pairs."""
    return timing.diff_peak(*_ev(spark, sf_dir))
