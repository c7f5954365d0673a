"""Registered exploration / data-quality queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.core import BAND_LETTERS, BANDS
from ..functions.windows import lag_columns
from ..operators import prep, research
from ..sources.adapters import lc_events, lc_lineitem, meta_events, meta_part, with_ctes
from .catalog import register
from .sqlgen import rounded

_HAV_SQL = ("2 * asin(sqrt(power(sin((radians(gal_b) - radians(decl)) / 2), 2) + cos(radians(decl)) * "
            "cos(radians(gal_b)) * power(sin((radians(gal_l) - radians(ra)) / 2), 2)))")


@register("basic_meta", rounded(with_ctes(
    "SELECT object_id, hostgal_photoz, hostgal_photoz_err, coalesce(distmod, 0) AS distmod, mwebv, "
    f"{_HAV_SQL} AS haversine, radians(ra) * radians(decl) - radians(gal_l) * radians(gal_b) AS latlon1, "
    "hostgal_photoz * exp(hostgal_photoz_err) AS hostgal_photoz_certain FROM meta", lc=None, meta=True)))
def q_basic_meta(spark, sf_dir):
    """Metadata features incl. haversine distance between the two coordinate pairs."""
    return research.basic_meta(meta_part(spark, sf_dir))


@register("class_share", rounded(with_ctes(
    "SELECT target, n_0, n_1, n_0 / nullif(sum(n_0) OVER (), 0) AS ratio_ddf0, "
    "n_1 / nullif(sum(n_1) OVER (), 0) AS ratio_ddf1 FROM (SELECT target, count(*) FILTER (WHERE ddf = 0) AS n_0, "
    "count(*) FILTER (WHERE ddf = 1) AS n_1 FROM meta GROUP BY target)", lc=None, meta=True),
    keys=("target", "n_0", "n_1")))
def q_class_share(spark, sf_dir):
    """Per class, share of the WFD (ddf=0) and DDF (ddf=1) populations."""
    return research.class_share_by_flag(meta_part(spark, sf_dir))


@register("crosstab", with_ctes(
    "SELECT target, count(*) FILTER (WHERE external = 0) AS external_0, count(*) FILTER (WHERE external = 1) "
    "AS external_1 FROM (SELECT target, CAST(hostgal_photoz != 0 AS INTEGER) AS external FROM meta) GROUP BY target",
    lc=None, meta=True))
def q_crosstab(spark, sf_dir):
    """Class x domain flag counts (missing cells 0)."""
    m = meta_part(spark, sf_dir).withColumn("external", (F.col("hostgal_photoz") != 0).cast("int"))
    return research.crosstab(m, "target", "external", [0, 1])


_META_COLS = ["object_id", "ra", "decl", "gal_l", "gal_b", "ddf", "hostgal_specz", "hostgal_photoz",
              "hostgal_photoz_err", "distmod", "mwebv", "target"]


@register("null_report", rounded(with_ctes(
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS n_null, "
                       f"count(*) FILTER (WHERE {c} IS NULL) / count(*) AS null_share FROM meta" for c in _META_COLS),
    lc=None, meta=True), keys=("\"column\"", "n_null")))
def q_null_report(spark, sf_dir):
    """NULL count and share per metadata column."""
    return research.null_report(meta_part(spark, sf_dir))


@register("max_series_length", with_ctes(
    "SELECT passband, max(n) AS max_length, count(*) AS n_series FROM "
    "(SELECT object_id, passband, count(*) AS n FROM lc GROUP BY 1, 2) GROUP BY passband"))
def q_max_series_length(spark, sf_dir):
    """Longest series and number of series per band."""
    return research.max_series_length(lc_lineitem(spark, sf_dir))


@register("series_length_distribution", with_ctes(
    "SELECT passband, length, count(*) AS n_series FROM "
    "(SELECT object_id, passband, count(*) AS length FROM lc GROUP BY 1, 2) GROUP BY 1, 2"))
def q_series_length_distribution(spark, sf_dir):
    """Number of series per (band, length)."""
    return research.series_length_distribution(lc_lineitem(spark, sf_dir))


@register("mean_by_detected", rounded(with_ctes(
    "SELECT passband, " + ", ".join(
        f"avg(f) FILTER (WHERE detected = {d}) AS flux_mean_detected{d}, "
        f"avg(e) FILTER (WHERE detected = {d}) AS flux_err_mean_detected{d}" for d in (0, 1))
    + " FROM (SELECT passband, object_id, detected, avg(flux) AS f, avg(flux_err) AS e FROM lc GROUP BY 1, 2, 3) "
      "GROUP BY passband"), keys=("passband",)))
def q_mean_by_detected(spark, sf_dir):
    """Per band, mean over objects of the per-object mean by detected flag."""
    return research.mean_by_detected(lc_lineitem(spark, sf_dir))


@register("duration_by_object", rounded(with_ctes(
    "SELECT m.object_id, m.target, a.* EXCLUDE (object_id) FROM meta m LEFT JOIN (SELECT object_id, "
    "max(mjd) AS mjd_max, min(mjd) AS mjd_min, max(mjd) - min(mjd) AS mjd_span, min(flux_err) AS flux_err_min, "
    "max(flux_err) AS flux_err_max, avg(flux_err) AS flux_err_mean, median(flux_err) AS flux_err_median "
    "FROM lc GROUP BY object_id) a ON a.object_id = m.object_id", meta=True), keys=("object_id", "target")))
def q_duration_by_object(spark, sf_dir):
    """G41 + J5: observation span and error stats per object with its class."""
    return research.duration_by_object(lc_lineitem(spark, sf_dir), meta_part(spark, sf_dir))


_STEPS_SQL = ("SELECT object_id, mjd - lag(mjd) OVER (PARTITION BY object_id ORDER BY mjd, passband) AS dt FROM lc")


@register("gap_histogram", rounded(with_ctes(
    "SELECT bin, lo + bin * (hi - lo) / 100 AS bin_lo, n FROM (SELECT coalesce(CAST(least(floor((dt - lo) * 100.0::DOUBLE "
    "/ (hi - lo)), 99) AS INTEGER), 0) AS bin, any_value(lo) AS lo, any_value(hi) AS hi, count(*) AS n "
    "FROM steps, (SELECT min(dt) AS lo, max(dt) AS hi FROM steps) GROUP BY 1)",
    lc="events", ctes=[("steps0", _STEPS_SQL), ("steps", "SELECT * FROM steps0 WHERE dt IS NOT NULL")]),
    keys=("bin", "n")))
def q_gap_histogram(spark, sf_dir):
    """100-bin histogram of the steps between consecutive observations."""
    return research.gap_histogram(lc_events(spark, sf_dir), bins=100)


def _lcs_sql() -> str:
    w = "(PARTITION BY object_id, passband)"
    base = (f"SELECT *, sum(flux * power(flux / nullif(flux_err, 0), 2)) OVER {w} / "
            f"nullif(sum(power(flux / nullif(flux_err, 0), 2)) OVER {w}, 0) AS m, median(flux) OVER {w} AS med, "
            f"stddev_samp(flux) OVER {w} AS sd FROM lc")
    aggs = []
    for b, n in zip(BANDS, BAND_LETTERS):
        f = f"FILTER (WHERE passband = {b})"
        aggs += [f"max(m) {f} AS {n}Mean", f"stddev_samp(flux / nullif(flux_err, 0)) {f} AS {n}Std",
                 f"(max(flux) {f} - min(flux) {f}) / nullif(max(m) {f}, 0) AS {n}Amp",
                 f"median(abs((flux - med) / nullif(m, 0))) {f} AS {n}MAD",
                 f"CAST(avg(CASE WHEN abs(flux - m) > sd THEN 1.0 ELSE 0.0 END) {f} AS DOUBLE) AS {n}Beyond",
                 # population skewness g1 from the adjusted one: g1 = G1 * (n-2) / sqrt(n(n-1))
                 f"skewness(flux) {f} * (count(flux) {f} - 2) / sqrt(count(flux) {f} * (count(flux) {f} - 1)) AS {n}Skew"]
    inner = f"SELECT object_id, {', '.join(aggs)} FROM lcs GROUP BY object_id"
    cols = [f"CASE WHEN {a}Mean > 0 AND {b}Mean > 0 THEN -2.5 * log10({a}Mean / {b}Mean) ELSE -999.0 END "
            f"AS {a}Minus{b.upper()}" for a, b in zip(BAND_LETTERS[:-1], BAND_LETTERS[1:])]
    excl = ", ".join(f"{n}Mean" for n in BAND_LETTERS)
    body = (f"SELECT m.object_id, f.* EXCLUDE (object_id, {excl}), {', '.join(cols)} FROM meta m LEFT JOIN "
            f"({inner}) f ON f.object_id = m.object_id")
    return rounded(with_ctes(body, lc="events", meta=True, ctes=[("lcs", base)]))


@register("lightcurve_summary", _lcs_sql())
def q_lightcurve_summary(spark, sf_dir):
    """Per-band normalised std, amplitude, MAD, beyond-1-std, skew and adjacent-band colours."""
    return research.lightcurve_summary(lc_events(spark, sf_dir), meta_events(spark, sf_dir))


@register("band_moments", rounded(with_ctes(
    "SELECT passband, avg(mag) AS flux_mean, stddev_samp(mag) AS flux_std, count(*) AS n FROM ("
    "SELECT l.passband, CASE WHEN l.flux < 1 THEN 2.5 * log10(2 - l.flux) ELSE -2.5 * log10(greatest(l.flux, 1)) END - coalesce(m.distmod, 0) AS mag "
    "FROM lc l JOIN meta m ON m.object_id = l.object_id WHERE m.hostgal_photoz != 0) GROUP BY passband", meta=True),
    keys=("passband", "n")))
def q_band_moments(spark, sf_dir):
    """Per-band mean / std of the pure magnitude over the stacked train and test splits' extragalactic objects."""
    lc = lc_lineitem(spark, sf_dir)
    both = prep.stack_splits(lc.filter("object_id % 2 = 0"), lc.filter("object_id % 2 <> 0"))
    return research.band_flux_moments(both, meta_part(spark, sf_dir))


@register("quantiles_by_class", rounded(with_ctes(
    "SELECT target, count(hostgal_photoz_err) AS n, " + ", ".join(
        f"quantile_cont(hostgal_photoz_err, {q}) AS {n}" for q, n in
        ((0.0, "q0"), (0.25, "q25"), (0.5, "q50"), (0.75, "q75"), (1.0, "q100")))
    + " FROM meta GROUP BY target", lc=None, meta=True), keys=("target", "n")))
def q_quantiles_by_class(spark, sf_dir):
    """Box-plot quantiles of the photo-z error per class."""
    return research.quantiles_by_class(meta_part(spark, sf_dir), "hostgal_photoz_err")


@register("histogram", with_ctes(
    "SELECT CAST(floor((mwebv - 0.0) / 0.1) AS INTEGER) AS bin, count(*) AS n FROM meta "
    "WHERE mwebv >= 0.0 AND mwebv < 3.0 GROUP BY 1", lc=None, meta=True))
def q_histogram(spark, sf_dir):
    """Fixed-edge histogram of mwebv (0 to 3 by 0.1)."""
    return research.fixed_histogram(meta_part(spark, sf_dir), "mwebv", 0.0, 3.0, 0.1)


# Fixed time-lag bin edges (days) of the delta-m / delta-t study.
DT_EDGES = [1 / 145, 2 / 145, 3 / 145, 4 / 145, 1 / 25, 2 / 25, 3 / 25, 1.5, 2.5, 3.5,
            4.5, 5.5, 7, 10, 20, 30, 60, 90, 120, 240, 600, 960, 2000, 4000]
_CONSEC_SQL = ("SELECT mjd - lag(mjd) OVER w AS dt, flux - lag(flux) OVER w AS dflux FROM lc "
               "WINDOW w AS (PARTITION BY object_id, passband ORDER BY mjd)")


def _consecutive_steps(lc):
    rows = lag_columns(lc, ["object_id", "passband"], "mjd", ["mjd", "flux"], "_prev_")
    return rows.select((F.col("mjd") - F.col("_prev_mjd")).alias("dt"),
                       (F.col("flux") - F.col("_prev_flux")).alias("dflux")).filter(F.col("dt").isNotNull())


def _h2_sql() -> str:
    xs = " + ".join(f"CASE WHEN dt >= {float(e)!r} THEN 1 ELSE 0 END" for e in DT_EDGES)
    last = float(DT_EDGES[-1])
    xi = f"CASE WHEN dt = {last!r} THEN {len(DT_EDGES) - 2} ELSE ({xs}) - 1 END"
    yi = "coalesce(CAST(least(floor((dflux - lo) * 20.0::DOUBLE / (hi - lo)), 19) AS INTEGER), 0)"
    body = (f"SELECT x_bin, y_bin, count(*) AS n FROM (SELECT {xi} AS x_bin, {yi} AS y_bin FROM st, "
            f"(SELECT min(dflux) AS lo, max(dflux) AS hi FROM st)) WHERE x_bin >= 0 AND x_bin < {len(DT_EDGES) - 1} "
            f"GROUP BY 1, 2")
    return with_ctes(body, lc="events", ctes=[("st0", _CONSEC_SQL), ("st", "SELECT * FROM st0 WHERE dt IS NOT NULL")])


@register("histogram2d", _h2_sql())
def q_histogram2d(spark, sf_dir):
    """G48 (2-D): consecutive-step time lag (irregular bins) x flux change (20 bins)."""
    return research.histogram2d(_consecutive_steps(lc_events(spark, sf_dir)), "dt", "dflux", DT_EDGES, 20)


_CORR_COLS = ["ra", "decl", "gal_l", "gal_b", "ddf", "hostgal_specz", "hostgal_photoz", "distmod", "mwebv"]


@register("correlations", rounded(with_ctes(
    "SELECT " + ", ".join(f"corr(hostgal_photoz_err, {c}) AS corr_{c}" for c in _CORR_COLS) + " FROM meta",
    lc=None, meta=True), keys=()))
def q_correlations(spark, sf_dir):
    """Correlation of the photo-z error with the other metadata columns."""
    return research.correlations(meta_part(spark, sf_dir), "hostgal_photoz_err", _CORR_COLS)


@register("box_join", with_ctes(
    "SELECT b.target, m.ddf, count(*) AS n FROM meta m JOIN (SELECT target, min(gal_l) AS min_gal_l, "
    "max(gal_l) AS max_gal_l, min(gal_b) AS min_gal_b, max(gal_b) AS max_gal_b FROM meta WHERE ddf = 1 "
    "GROUP BY target) b ON m.gal_l BETWEEN b.min_gal_l AND b.max_gal_l AND m.gal_b BETWEEN b.min_gal_b AND "
    "b.max_gal_b GROUP BY 1, 2", lc=None, meta=True))
def q_box_join(spark, sf_dir):
    """Objects per (class box of ddf objects, ddf flag) by a point-in-box range join."""
    m = meta_part(spark, sf_dir)
    return research.box_coverage(m, research.class_boxes(m, "target"), "target")


@register("kmeans_regions")
def q_kmeans_regions(spark, sf_dir):
    """K-means (k=5) regions of ddf objects and their box coverage (rows-only check)."""
    return research.region_boxes(meta_part(spark, sf_dir), k=5, seed=0)


_MATRIX_COLS = ["hostgal_photoz", "hostgal_photoz_err", "mwebv", "decl"]


@register("correlation_matrix", rounded(with_ctes(" UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, " + ("1.0::DOUBLE" if a == b else f"corr({a}, {b})") + " AS r FROM meta"
    + (" WHERE object_id = (SELECT min(object_id) FROM meta)" if a == b else "") for a in _MATRIX_COLS for b in _MATRIX_COLS), lc=None, meta=True), keys=("a", "b")))
def q_correlation_matrix(spark, sf_dir):
    """Full correlation matrix in long form."""
    return research.correlation_matrix(meta_part(spark, sf_dir), _MATRIX_COLS)


@register("redshift_outliers", rounded(with_ctes(
    "SELECT object_id, hostgal_specz, hostgal_photoz, abs(hostgal_specz - hostgal_photoz) AS z_gap FROM meta "
    "WHERE abs(hostgal_specz - hostgal_photoz) > 0.05", lc=None, meta=True)))
def q_redshift_outliers(spark, sf_dir):
    """P20: objects whose two redshifts disagree."""
    return prep.redshift_outliers(meta_part(spark, sf_dir), 0.05).select("object_id", "hostgal_specz", "hostgal_photoz", "z_gap")
