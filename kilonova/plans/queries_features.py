"""Registered feature queries on the lineitem / part adapters."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import BANDS, distmod_flat_lcdm
from ..operators import peaks, scaling, stats
from ..sources import io
from ..sources.adapters import lc_lineitem, meta_part, with_ctes
from .catalog import register
from .sqlgen import RATIO_COLS_SQL, agg_sql, ratio_sql, rounded

# ---------------------------------------------------------------- SQL builders (oracle side)


def object_stats_sql(src: str, spec=stats.OBJECT_SPEC, detected_variant=True, detected_span=False,
                     drop=()) -> str:
    """Per-object stats over CTE ``src`` restored onto ``meta``."""
    aggs = agg_sql(spec)
    if detected_span:
        aggs.append("max(mjd) FILTER (WHERE detected = 1) - min(mjd) FILTER (WHERE detected = 1) "
                    "AS diff_mjd_maxmin_detected1")
    if detected_variant:
        aggs += agg_sql(spec, where="detected = 1", suffix="_detected1",
                        drop=set(drop) & {"detected_mean_detected1"})
    ratios = ratio_sql("") + (ratio_sql("_detected1") if detected_variant else [])
    inner = (f"SELECT object_id, {', '.join(aggs)} FROM (SELECT *, {RATIO_COLS_SQL} FROM {src}) "
             f"GROUP BY object_id")
    body = f"SELECT *, {', '.join(ratios)} FROM ({inner})"
    kept = [d for d in drop if not d.endswith("_detected1") or detected_variant]
    excl = ", ".join(["object_id"] + [d for d in kept if d not in ("detected_mean_detected1",)])
    return f"SELECT m.object_id, f.* EXCLUDE ({excl}) FROM meta m LEFT JOIN ({body}) f ON f.object_id = m.object_id"


def _band_agg_sql() -> list[str]:
    out = []
    for b in BANDS:
        out += agg_sql(stats.BAND_SPEC, where=f"passband = {b}", suffix=f"_{b}")
    return out


def _band_ratio_sql() -> list[str]:
    out = []
    for b in BANDS:
        out += ratio_sql(f"_{b}")
    return out


def _contrast_sql(stats_list=("max", "min", "mean", "diff", "dif2", "w_mean", "dif3"), base=5,
                  targets=(0, 1, 2, 3, 4)) -> list[str]:
    return [f"flux_{s}_{base} - flux_{s}_{t} AS flux_{s}_diff_{base}_{t}" for t in targets for s in stats_list]


def band_features_sql(src: str, contrasts: bool = True, drop_stats=("min", "max", "mean", "diff")) -> str:
    """Per-band stats over CTE ``src`` (raw lc columns) restored onto ``meta``."""
    dropped = [f"flux_{s}_{b}" for s in drop_stats for b in BANDS]
    inner = (f"SELECT object_id, {', '.join(_band_agg_sql())} FROM (SELECT *, {RATIO_COLS_SQL} FROM {src}) "
             f"GROUP BY object_id")
    step1 = f"SELECT *, {', '.join(_band_ratio_sql())} FROM ({inner})"
    step2 = f"SELECT *{', ' + ', '.join(_contrast_sql()) if contrasts else ''} FROM ({step1})"
    excl = ", ".join(["object_id"] + dropped)
    return f"SELECT m.object_id, f.* EXCLUDE ({excl}) FROM meta m LEFT JOIN ({step2}) f ON f.object_id = m.object_id"


PHOTOZ2_SQL = ("SELECT lc.object_id, lc.mjd, lc.passband, lc.flux * d.dist AS flux, lc.flux_err * d.dist AS flux_err, "
               "lc.detected FROM {src} lc JOIN (SELECT object_id, nullif(power(hostgal_photoz, 2), 0) AS dist "
               "FROM meta WHERE hostgal_photoz != 0) d ON d.object_id = lc.object_id")
DISTMOD_SQL = ("SELECT lc.object_id, lc.mjd, lc.passband, lc.flux * power(10, d.dm / 2.5) AS flux, "
               "lc.flux_err * power(10, d.dm / 2.5) AS flux_err, lc.detected FROM {src} lc JOIN "
               "(SELECT object_id, distmod AS dm FROM meta WHERE hostgal_photoz != 0) d ON d.object_id = lc.object_id")


def gap_segment_sql(src: str = "lc", gap: float = 100.0) -> list[tuple[str, str]]:
    """CTEs ending in ``peak_rows``: rows of the gap segment holding the max flux."""
    return [
        ("seg0", f"SELECT *, CASE WHEN mjd - lag(mjd) OVER (PARTITION BY object_id ORDER BY mjd, passband) > {gap} "
                 f"THEN 1 ELSE 0 END AS new_seg FROM {src}"),
        ("seg1", "SELECT *, sum(new_seg) OVER (PARTITION BY object_id ORDER BY mjd, passband "
                 "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS segment FROM seg0"),
        ("seg2", "SELECT *, coalesce(max(flux) OVER (PARTITION BY object_id, segment), 0) AS segmax FROM seg1"),
        ("seg3", "SELECT *, max(segmax) OVER (PARTITION BY object_id) AS objmax FROM seg2"),
        ("seg4", "SELECT *, min(CASE WHEN segmax = objmax THEN segment END) OVER (PARTITION BY object_id) AS best "
                 "FROM seg3"),
        ("peak_rows", "SELECT object_id, mjd, passband, flux, flux_err, detected FROM seg4 WHERE segment = best"),
    ]


def peak_window_sql(src: str = "lc", w: float = 100.0) -> list[tuple[str, str]]:
    return [
        ("pw0", f"SELECT *, first_value(mjd) OVER (PARTITION BY object_id ORDER BY flux DESC, mjd ASC) AS peak FROM {src}"),
        ("peak_rows", f"SELECT object_id, mjd, passband, flux, flux_err, detected FROM pw0 "
                      f"WHERE mjd >= peak - {w} AND mjd < peak + {w}"),
    ]


def _q(body: str, ctes=None) -> str:
    return rounded(with_ctes(body, lc="lineitem", meta=True, ctes=ctes))


def _lc_meta(spark, sf_dir):
    return lc_lineitem(spark, sf_dir), meta_part(spark, sf_dir)


NO_DET = stats.OBJECT_SPEC_NO_DETECTED

# ---------------------------------------------------------------- registrations


@register("basic_ts", _q(object_stats_sql("lc", detected_span=True, drop=("detected_mean_detected1",))))
def q_basic_ts(spark, sf_dir):
    """G5 + J3 (flagship): per-object stats, detected-row stats, detected span, ratios."""
    return stats.basic_ts(*_lc_meta(spark, sf_dir))


@register("basic_ts_passband", _q(band_features_sql("lc")))
def q_basic_ts_passband(spark, sf_dir):
    """Per-band stats as columns, ratios, band-5 contrasts."""
    return stats.basic_ts_passband(*_lc_meta(spark, sf_dir))


@register("fluxfactor", _q(object_stats_sql("ff", NO_DET, drop=scaling.FLUXFACTOR_DROP),
                           [("ff", PHOTOZ2_SQL.format(src="lc"))]))
def q_fluxfactor(spark, sf_dir):
    """G10 + G11: stats of photoz^2-scaled flux of extragalactic objects."""
    return scaling.fluxfactor(*_lc_meta(spark, sf_dir))


@register("fluxfactor_passband", _q(band_features_sql("ff", drop_stats=()), [("ff", PHOTOZ2_SQL.format(src="lc"))]))
def q_fluxfactor_passband(spark, sf_dir):
    """Band features of photoz^2-scaled flux."""
    return scaling.fluxfactor_passband(*_lc_meta(spark, sf_dir))


@register("scale_by_distmod", _q(object_stats_sql("dm", NO_DET, drop=scaling.FLUXFACTOR_DROP),
                                 [("dm", DISTMOD_SQL.format(src="lc"))]))
def q_scale_by_distmod(spark, sf_dir):
    """G13 + G14: stats of distance-modulus-scaled flux (sign kept)."""
    return scaling.fluxfactor_v2(*_lc_meta(spark, sf_dir))


@register("fluxfactor_passband_v2", _q(band_features_sql("dm"), [("dm", DISTMOD_SQL.format(src="lc"))]))
def q_fluxfactor_passband_v2(spark, sf_dir):
    """G14 (band form)."""
    return scaling.fluxfactor_passband_v2(*_lc_meta(spark, sf_dir))


@register("maxpoint_gap", _q(object_stats_sql("peak_rows", NO_DET), gap_segment_sql()))
def q_maxpoint_gap(spark, sf_dir):
    """G15 + G17: stats on the 100-day gap segment holding the peak."""
    return peaks.maxpoint(*_lc_meta(spark, sf_dir), mode="gap", width=100.0)


@register("maxpoint_window", _q(object_stats_sql("peak_rows", NO_DET), peak_window_sql(w=200.0)))
def q_maxpoint_window(spark, sf_dir):
    """G16 + G17: stats on rows within 200 days of the peak."""
    return peaks.maxpoint(*_lc_meta(spark, sf_dir), mode="window", width=200.0)


@register("maxpoint_passband", _q(band_features_sql("peak_rows", contrasts=False, drop_stats=()), gap_segment_sql()))
def q_maxpoint_passband(spark, sf_dir):
    """Band stats on the gap segment of the peak."""
    return peaks.maxpoint_passband(*_lc_meta(spark, sf_dir))


_PM_SQL = ("SELECT p.object_id, p.mjd, p.passband, (CASE WHEN p.flux < 1 THEN 2.5 * log10(2 - p.flux) "
           "ELSE -2.5 * log10(p.flux) END) - m.distmod AS flux, p.flux_err, p.detected "
           "FROM peak_rows p JOIN meta m ON m.object_id = p.object_id WHERE p.detected = 1")


@register("maxpoint_passband_v2", _q(band_features_sql("pm", drop_stats=()), peak_window_sql(w=100.0) + [("pm", _PM_SQL)]))
def q_maxpoint_passband_v2(spark, sf_dir):
    """Detected peak-window rows as pure magnitude, band features."""
    return peaks.maxpoint_passband_v2(*_lc_meta(spark, sf_dir), half_width=100.0)


@register("fluxfactor_maxpoint", _q(object_stats_sql("ffp", NO_DET),
                                    gap_segment_sql() + [("ffp", PHOTOZ2_SQL.format(src="peak_rows"))]))
def q_fluxfactor_maxpoint(spark, sf_dir):
    """photoz^2 scaling on the peak segment, object stats."""
    return peaks.fluxfactor_maxpoint(*_lc_meta(spark, sf_dir))


@register("fluxfactor_maxpoint_passband", _q(band_features_sql("ffp", contrasts=False, drop_stats=()),
                                             gap_segment_sql() + [("ffp", PHOTOZ2_SQL.format(src="peak_rows"))]))
def q_fluxfactor_maxpoint_passband(spark, sf_dir):
    """G20 (band form)."""
    return peaks.fluxfactor_maxpoint_passband(*_lc_meta(spark, sf_dir))


# ---------------------------------------------------------------- redshift path

# comoving distance of a flat universe (H0 70, matter 0.3) by Simpson's rule on a far finer grid than the query's
_DM_Z = ("SELECT object_id, 5 * log10((1 + z) * 299792.458 / 70 * z / 12000 * sum(e)) + 25 AS dm FROM ("
         "SELECT object_id, z, (CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) / sqrt(0.3 * power(1 + z * k / 4000, 3) + 0.7) AS e "
         "FROM (SELECT object_id, {z} AS z FROM meta WHERE {z} > 0) m, (SELECT unnest(range(0, 4001)) AS k) g) GROUP BY object_id, z")


@register("distmod_z", with_ctes("SELECT m.object_id, round(d.dm, 5) AS distmod FROM meta m LEFT JOIN d ON d.object_id = m.object_id", lc=None,
                                 meta=True, ctes=[("d", _DM_Z.format(z="hostgal_specz"))]), bits=None)
def q_distmod_z(spark, sf_dir):
    """distance modulus of the spectroscopic redshift."""
    return meta_part(spark, sf_dir).select("object_id", F.round(distmod_flat_lcdm("hostgal_specz"), 5).alias("distmod"))


@register("scale_by_redshift", with_ctes(
    "SELECT l.object_id, round(log10(sum(abs(l.flux)) * power(10, any_value(d.dm) / 2.5)), 5) AS log_flux FROM lc l JOIN d ON d.object_id = l.object_id "
    "JOIN meta m ON m.object_id = l.object_id WHERE m.hostgal_photoz != 0 GROUP BY l.object_id", meta=True,
    ctes=[("d", _DM_Z.format(z="hostgal_photoz"))]), bits=None)
def q_scale_by_redshift(spark, sf_dir):
    """G13 on a redshift column: summed absolute flux at the distance of the photometric redshift (log10)."""
    rows = scaling.scale_by_distmod(lc_lineitem(spark, sf_dir), meta_part(spark, sf_dir), z_col="hostgal_photoz")
    return rows.groupBy("object_id").agg(F.round(F.log10(F.sum(F.abs("flux"))), 5).alias("log_flux"))


@register("peak_store", _q("SELECT a.object_id, a.flux_max, a.flux_mean, b.flux_w_mean_0, b.flux_w_mean_5 FROM ("
                           + object_stats_sql("peak_rows", NO_DET) + ") a JOIN (" + band_features_sql("peak_rows", contrasts=False, drop_stats=())
                           + ") b ON b.object_id = a.object_id", gap_segment_sql()))
def q_peak_store(spark, sf_dir):
    """The rows of the peak segments written once, object and band sets read from them."""
    meta = meta_part(spark, sf_dir)
    rows = io.read_features(spark, io.write_features(peaks.segment_by_gap(lc_lineitem(spark, sf_dir), 100.0), io.scratch_path(spark, "peak-rows")))
    a = stats.object_stats(rows, meta, detected=False, detected_variant=True, drop=()).select("object_id", "flux_max", "flux_mean")
    b = stats.band_features(rows, meta, contrasts=False, drop_stats=()).select("object_id", "flux_w_mean_0", "flux_w_mean_5")
    return a.join(b, "object_id")
