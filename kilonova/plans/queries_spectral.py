"""Registered periodogram and lag-correlation queries."""
from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import spectral
from ..sources.adapters import lc_events, meta_events, with_ctes
from .catalog import register
from .sqlgen import rounded, snap_sql

def power_ctes(src: str = "lc", prefix: str = "") -> list[tuple[str, str]]:
    """CTEs up to ``<prefix>pw`` (object_id, passband, freq, n, power): direct sums on the grid whose step follows the time
    span.  ``src`` has object_id, passband, t, y, w; ``grid`` has f0, step, n."""
    tw = 2 * math.pi
    ex = (f"SELECT object_id, passband, y, w, k, f0 + k * step AS freq, cos({tw!r} * (f0 + k * step) * t) AS c, "
          f"sin({tw!r} * (f0 + k * step) * t) AS s FROM {src}, grid, (SELECT unnest(range(0, (SELECT n FROM grid))) AS k)")
    sums = ("SELECT object_id, passband, k, any_value(freq) AS freq, count(*) AS n, sum(w) AS W, sum(w * y) / sum(w) AS Y, "
            "sum(w * c) / sum(w) AS C, sum(w * s) / sum(w) AS S, sum(w * y * y) / sum(w) AS YY, "
            "sum(w * y * c) / sum(w) AS YC, sum(w * y * s) / sum(w) AS YS, sum(w * c * c) / sum(w) AS CC, "
            f"sum(w * s * s) / sum(w) AS SS, sum(w * c * s) / sum(w) AS CS FROM {prefix}ex GROUP BY 1, 2, 3")
    cen = ("SELECT object_id, passband, freq, n, YY, YY - Y * Y AS yy_, YC - Y * C AS yc_, YS - Y * S AS ys_, "
           f"CC - C * C AS cc_, SS - S * S AS ss_, CS - C * S AS cs_ FROM {prefix}sums")
    # a spread or a determinant that is rounding only leaves the power undefined
    pw = ("SELECT object_id, passband, freq, n, CASE WHEN n >= 3 AND yy_ > 1e-12 * YY AND cc_ * ss_ - cs_ * cs_ > 1e-9 THEN "
          "(ss_ * yc_ * yc_ + cc_ * ys_ * ys_ - 2 * cs_ * yc_ * ys_) / (yy_ * (cc_ * ss_ - cs_ * cs_)) END AS power "
          f"FROM {prefix}cen")
    return [(f"{prefix}ex", ex), (f"{prefix}sums", sums), (f"{prefix}cen", cen), (f"{prefix}pw", pw)]


def grid_cte(src: str = "lc") -> tuple[str, str]:
    """The grid of ``frequency.span_grid``."""
    return ("grid", "SELECT f0, step, CAST(floor((10.0::DOUBLE - f0) / step) AS BIGINT) + 1 AS n FROM (SELECT 1.0::DOUBLE / t AS f0, "
            f"1.0::DOUBLE / (5 * t) AS step FROM (SELECT max(mjd) - min(mjd) AS t FROM {src}))")


def rows_cte(src: str = "lc") -> tuple[str, str]:
    """Rows of ``frequency.weighted_rows``."""
    return ("wrows", f"SELECT object_id, passband, mjd - (SELECT min(mjd) FROM {src}) AS t, flux AS y, power(1 / nullif(flux_err, 0), 2) AS w "
            f"FROM {src} WHERE flux_err != 0 AND flux IS NOT NULL")


def _power_sql() -> list[tuple[str, str]]:
    return [grid_cte(), rows_cte(), *power_ctes("wrows")]


def _peaks_sql() -> str:
    body = ("SELECT object_id, passband, freq AS freq_best, power AS power_max, 1 / freq AS period_fast FROM "
            f"(SELECT *, row_number() OVER (PARTITION BY object_id, passband ORDER BY {snap_sql('power')} DESC, freq ASC) AS rn "
            "FROM pw WHERE power IS NOT NULL) WHERE rn = 1")
    return rounded(with_ctes(body, lc="events", ctes=_power_sql()), keys=("object_id", "passband"))


@register("periodogram", _peaks_sql())
def q_periodogram(spark, sf_dir):
    """Generalised Lomb-Scargle peak frequency, power and period per band; the grid's step follows the span."""
    return spectral.periodogram_peaks(lc_events(spark, sf_dir))


def _multiband_sql() -> str:
    body = ("SELECT m.object_id, b.freq AS freq_best, b.power AS power_max, 1 / b.freq AS period_fast FROM meta m "
            f"LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY {snap_sql('power')} "
            "DESC, freq ASC) AS rn FROM (SELECT object_id, freq, sum(power) AS power FROM pw WHERE power IS NOT NULL "
            "GROUP BY 1, 2)) WHERE rn = 1) b ON b.object_id = m.object_id")
    return rounded(with_ctes(body, lc="events", meta=True, ctes=_power_sql()))


@register("periodogram_multiband", _multiband_sql())
def q_periodogram_multiband(spark, sf_dir):
    """F8 (multiband): band-summed power peak per object; the grid's step follows the span."""
    return spectral.multiband_periodogram(lc_events(spark, sf_dir), meta_events(spark, sf_dir))


XC = dict(band1=1, band2=5, lo=-10.0, hi=10.0, step=1.0)


def _xcorr_sql() -> str:
    lags = spectral.lag_grid(XC["lo"], XC["hi"], XC["step"])
    lag_list = ", ".join(repr(float(v)) for v in lags)
    point = "object_id || ':' || CAST(round(mjd * 86400000) AS BIGINT)"
    probes = (f"SELECT object_id, mjd + l AS q, l AS lag, flux AS y1, {point} AS point FROM lc, (SELECT unnest([{lag_list}]::DOUBLE[]) AS l) "
              f"WHERE passband = {XC['band1']}")
    b2 = f"SELECT object_id, mjd AS t, flux AS y FROM lc WHERE passband = {XC['band2']}"
    prev = ("SELECT p.*, b.t AS tp, b.y AS yp FROM probes p ASOF JOIN b2 b ON p.object_id = b.object_id AND b.t <= p.q")
    nxt = ("SELECT p.*, b.t AS tn, b.y AS yn FROM prev p ASOF JOIN b2 b ON p.object_id = b.object_id AND b.t >= p.q")
    pairs = ("SELECT object_id, lag, y1, point, CASE WHEN tn = tp THEN yp ELSE yp + (yn - yp) * (q - tp) / (tn - tp) END AS y2 "
             "FROM nxt")
    r = ("SELECT object_id, lag, corr(y1, y2) AS r FROM pairs GROUP BY 1, 2 HAVING corr(y1, y2) IS NOT NULL "
         "AND NOT isnan(corr(y1, y2))")
    peak = ("SELECT object_id, lag AS peak_lag, max_r AS peak_r FROM (SELECT *, max(r) OVER (PARTITION BY object_id) AS "
            f"max_r, row_number() OVER (PARTITION BY object_id ORDER BY {snap_sql('r')} DESC, lag ASC) AS rn FROM r) "
            "WHERE rn = 1")
    # Poisson(1) weights of every band1 point and replicate, written as the cumulated shares
    share, limits = 0.0, []
    for k in range(8):
        share += math.exp(-1) / math.factorial(k)
        limits.append(math.floor(share * 65536))
    weight = " + ".join(f"CASE WHEN h >= {x} THEN 1 ELSE 0 END" for x in limits)
    drawn = ("SELECT point, i * 8 + j AS rep, CAST('0x' || substring(md5(point || ':' || i), 1 + 4 * j, 4) AS INTEGER) AS h FROM "
             f"(SELECT DISTINCT point FROM pairs), (SELECT unnest(range(0, {-(-spectral.REPLICATES // 8)})) AS i), (SELECT unnest(range(0, 8)) AS j) "
             f"WHERE i * 8 + j < {spectral.REPLICATES}")
    draws = f"SELECT point, rep, {weight} AS k FROM drawn WHERE ({weight}) > 0"
    centred = ("SELECT *, y1 - avg(y1) OVER (PARTITION BY object_id, lag) AS x, y2 - avg(y2) OVER (PARTITION BY object_id, lag) AS y FROM pairs")
    sums = ("SELECT object_id, lag, rep, sum(k * x) / sum(k) AS mx, sum(k * y) / sum(k) AS my, sum(k * x * x) / sum(k) AS xx, sum(k * y * y) / sum(k) AS yy, "
            "sum(k * x * y) / sum(k) AS xy FROM centred JOIN draws USING (point) GROUP BY 1, 2, 3")
    rr = ("SELECT object_id, lag, rep, (xy - mx * my) / sqrt((xx - mx * mx) * (yy - my * my)) AS r FROM sums "
          "WHERE xx - mx * mx > 1e-9 * xx AND yy - my * my > 1e-9 * yy")
    tops = (f"SELECT *, max(r) OVER p AS top, row_number() OVER (PARTITION BY object_id, rep ORDER BY {snap_sql('r')} DESC, lag) AS rn FROM rr "
            "WINDOW p AS (PARTITION BY object_id, rep)")
    good = ("SELECT object_id, rep, max(lag) FILTER (WHERE rn = 1) AS peak, avg(lag) FILTER (WHERE r >= 0.8 * top) AS cen FROM tops "
            f"GROUP BY 1, 2 HAVING max(r) > {spectral.LEAST_R!r}")
    lo, up = repr(1 - spectral.PERCENTILE), repr(spectral.PERCENTILE)
    errs = (f"SELECT object_id, quantile_cont(cen, {lo}) AS c0, quantile_cont(cen, 0.5) AS c1, quantile_cont(cen, {up}) AS c2, "
            f"quantile_cont(peak, {lo}) AS p0, quantile_cont(peak, 0.5) AS p1, quantile_cont(peak, {up}) AS p2, count(*) AS n FROM good GROUP BY 1")
    cols = ", ".join(f"max(r.r) FILTER (WHERE r.lag = {float(v)!r}) AS r_lag_{i}" for i, v in enumerate(lags))
    body = (f"SELECT m.object_id, p.peak_lag, p.peak_r, c.* EXCLUDE (object_id), e.c1 AS centau, e.c2 - e.c1 AS centau_uperr, e.c1 - e.c0 AS centau_loerr, "
            "e.p1 AS peaktau, e.p2 - e.c1 AS peaktau_uperr, e.c1 - e.p0 AS peaktau_loerr, CASE WHEN p.object_id IS NOT NULL THEN "
            f"coalesce(e.n, 0) / {spectral.REPLICATES}::DOUBLE END AS success_ratio FROM meta m LEFT JOIN peak p ON "
            f"p.object_id = m.object_id LEFT JOIN (SELECT r.object_id, avg(r.lag) FILTER (WHERE r.r >= pk.peak_r * 0.8) "
            f"AS centroid_lag, {cols} FROM r JOIN peak pk ON pk.object_id = r.object_id GROUP BY r.object_id) c "
            f"ON c.object_id = m.object_id LEFT JOIN errs e ON e.object_id = m.object_id")
    return rounded(with_ctes(body, lc="events", meta=True, ctes=[
        ("probes", probes), ("b2", b2), ("prev", prev), ("nxt", nxt), ("pairs", pairs), ("r", r), ("peak", peak), ("drawn", drawn), ("draws", draws),
        ("centred", centred), ("sums", sums), ("rr", rr), ("tops", tops), ("good", good), ("errs", errs)]))


@register("cross_correlation", _xcorr_sql())
def q_cross_correlation(spark, sf_dir):
    """Interpolated cross-correlation of band 5 against band 1 on a lag grid, errors by resampling."""
    return spectral.cross_correlation(lc_events(spark, sf_dir), meta_events(spark, sf_dir), **XC)


DC = dict(band1=1, band2=5, lo=-10.0, hi=10.0, bin_width=2.0)


def _dcf_sql(weighting: str = "slot") -> str:
    edges = spectral.lag_grid(DC["lo"], DC["hi"], DC["bin_width"])
    nb = len(edges) - 1
    bins = ", ".join(f"({k}, {edges[k]!r}, {edges[k + 1]!r})" for k in range(nb))
    inside = "b.mjd - a.mjd > k.lo AND b.mjd - a.mjd < k.hi"
    if weighting == "gauss":   # the kernel's threshold
        h = DC["bin_width"] / 4
        kernel = f"exp(-power(b.mjd - a.mjd - (k.lo + k.hi) / 2, 2) / (2 * power({h!r}, 2)))"
        inside = f"{kernel} >= exp(-power({spectral.GAUSS_REACH!r}, 2) / 2)"
    pairs = (f"SELECT a.object_id, k.bin, (k.lo + k.hi) / 2 AS lag, a.flux AS x, a.flux_err AS ex, b.flux AS y, "
             f"b.flux_err AS ey FROM lc a JOIN lc b ON a.object_id = b.object_id AND a.passband = {DC['band1']} AND "
             f"b.passband = {DC['band2']} JOIN (SELECT * FROM (VALUES {bins}) t(bin, lo, hi)) k ON "
             f"{inside}")
    st = ("SELECT object_id, bin, any_value(lag) AS lag, count(*) AS n, avg(x) AS mx, avg(y) AS my, "
          "CASE WHEN (var_pop(x) - power(avg(ex), 2)) * (var_pop(y) - power(avg(ey), 2)) > 0 THEN "
          "sqrt((var_pop(x) - power(avg(ex), 2)) * (var_pop(y) - power(avg(ey), 2))) END AS den FROM pairs GROUP BY 1, 2")
    d1 = ("SELECT p.object_id, p.bin, (p.x - s.mx) * (p.y - s.my) / nullif(s.den, 0) AS dcfs FROM pairs p JOIN st s "
          "ON p.object_id = s.object_id AND p.bin = s.bin")
    d2 = "SELECT object_id, bin, sum(dcfs) / count(*) AS dcf FROM d1 GROUP BY 1, 2"
    body = ("SELECT s.object_id, CAST(s.bin AS INTEGER) AS bin, s.lag, s.n AS n_pairs, d2.dcf, "
            "CASE WHEN d2.dcf IS NOT NULL THEN sqrt(greatest((SELECT sum(power(d1.dcfs - d2.dcf, 2)) FROM d1 WHERE d1.object_id = s.object_id AND "
            "d1.bin = s.bin), 0)) / nullif(s.n - 1, 0) END AS dcf_err FROM st s JOIN d2 ON d2.object_id = s.object_id AND "
            "d2.bin = s.bin")
    return rounded(with_ctes(body, lc="events", ctes=[("pairs", pairs), ("st", st), ("d1", d1), ("d2", d2)]),
                   keys=("object_id", "bin", "n_pairs"))


@register("discrete_correlation", _dcf_sql())
def q_discrete_correlation(spark, sf_dir):
    """Slot-weighted discrete correlation per 2-day lag bin, without pair materialisation."""
    return spectral.discrete_correlation(lc_events(spark, sf_dir), **DC)


@register("discrete_correlation_gauss", _dcf_sql("gauss"))
def q_discrete_correlation_gauss(spark, sf_dir):
    """As ``discrete_correlation`` with the overlapping slots of the gaussian kernel's threshold."""
    return spectral.discrete_correlation(lc_events(spark, sf_dir), weighting="gauss", **DC)


@register("detrend", rounded(with_ctes(
    "SELECT object_id, passband, mjd, t0, flux - (slope * t0 + (sy - slope * sx) / nullif(sw, 0)) AS resid FROM ("
    "SELECT *, CASE WHEN tl > tf THEN (sw * sxy - sx * sy) / nullif(sw * sxx - sx * sx, 0) END AS slope FROM (SELECT *, "
    "max(t0) OVER b AS tl, min(t0) OVER b AS tf, sum(w) OVER b AS sw, sum(w * t0) OVER b AS sx, sum(w * flux) OVER b AS sy, sum(w * t0 * t0) OVER b AS sxx, "
    "sum(w * t0 * flux) OVER b AS sxy FROM (SELECT *, mjd - min(mjd) OVER (PARTITION BY object_id) AS t0, "
    "power(1 / nullif(flux_err, 0), 2) AS w FROM lc WHERE passband IN (1, 5)) WINDOW b AS (PARTITION BY object_id, "
    "passband)))", lc="events"), keys=("object_id", "passband")))
def q_detrend(spark, sf_dir):
    """common time origin and weighted linear detrend of bands 1 and 5."""
    return spectral.detrend(lc_events(spark, sf_dir), (1, 5), degree=1)


@register("detrend_mean", rounded(with_ctes(
    "SELECT object_id, passband, mjd, mjd - min(mjd) OVER (PARTITION BY object_id) AS t0, "
    "flux - avg(flux) OVER (PARTITION BY object_id, passband) AS resid FROM lc WHERE passband IN (1, 5)", lc="events"),
    keys=("object_id", "passband")))
def q_detrend_mean(spark, sf_dir):
    """common time origin and mean subtraction of bands 1 and 5."""
    return spectral.detrend(lc_events(spark, sf_dir), (1, 5), degree=0)


# the parabola of the reference: normal equations solved by elimination (the query uses cofactors)
_QUAD = """
SELECT object_id, passband, mjd, t0, flux - (c0 + c1 * t0 + c2 * t0 * t0) AS resid FROM (
  SELECT *, (y0 - c1 * t1 - c2 * t2) / nullif(s0, 0) AS c0 FROM (
    SELECT *, (b1 - c2 * a12) / nullif(a11, 0) AS c1 FROM (
      SELECT *, (b2 - a12 * b1 / nullif(a11, 0)) / nullif(a22 - a12 * a12 / nullif(a11, 0), 0) AS c2 FROM (
        SELECT *, t2 - t1 * t1 / s0 AS a11, t3 - t1 * t2 / s0 AS a12, t4 - t2 * t2 / s0 AS a22, y1 - t1 * y0 / s0 AS b1, y2 - t2 * y0 / s0 AS b2
        FROM (SELECT *, sum(w) OVER b AS s0, sum(w * t0) OVER b AS t1, sum(w * t0 ** 2) OVER b AS t2, sum(w * t0 ** 3) OVER b AS t3,
              sum(w * t0 ** 4) OVER b AS t4, sum(w * flux) OVER b AS y0, sum(w * flux * t0) OVER b AS y1, sum(w * flux * t0 ** 2) OVER b AS y2
              FROM (SELECT *, mjd - min(mjd) OVER (PARTITION BY object_id) AS t0, power(1 / nullif(flux_err, 0), 2) AS w FROM lc
                    WHERE passband IN (1, 5)) WINDOW b AS (PARTITION BY object_id, passband))))))
"""


@register("detrend_quadratic", "SELECT object_id, passband, n_points, round(mse, 6) AS mse FROM (SELECT object_id, passband, "
          "count(*) AS n_points, avg(resid * resid) AS mse FROM (" + with_ctes(_QUAD, lc="events") + ") GROUP BY 1, 2) WHERE n_points > 3", bits=None)
def q_detrend_quadratic(spark, sf_dir):
    """weighted quadratic detrend of bands 1 and 5: mean squared residual of series of more than three points."""
    r = spectral.detrend(lc_events(spark, sf_dir), (1, 5), degree=2)
    out = r.groupBy("object_id", "passband").agg(F.count(F.lit(1)).alias("n_points"), F.avg(F.col("resid") * F.col("resid")).alias("mse"))
    return out.filter("n_points > 3").withColumn("mse", F.round("mse", 6))


_LAG_SQL = with_ctes(
    "SELECT object_id, base, target, lag, xcorr, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY "
    f"object_id, base, target ORDER BY {snap_sql('xcorr')} DESC, lag ASC) AS rank FROM (SELECT a.object_id, a.base, a.target, "
    "CAST(a.pos - b.pos AS INTEGER) AS lag, sum(a.x * b.y) AS xcorr FROM s a JOIN s b ON a.object_id = b.object_id AND a.base = b.base "
    "GROUP BY 1, 2, 3, 4)) WHERE rank <= 3", lc="events", ctes=[
        ("cells", "SELECT object_id, passband, CAST(floor(mjd) AS BIGINT) AS bucket, avg(flux) AS f FROM lc GROUP BY 1, 2, 3"),
        ("s", "SELECT x.object_id, x.passband AS base, y.passband AS target, x.f AS x, y.f AS y, row_number() OVER (PARTITION BY x.object_id, "
              "x.passband ORDER BY x.bucket) AS pos FROM cells x JOIN cells y ON x.object_id = y.object_id AND x.bucket = y.bucket "
              "AND x.passband < 5 AND y.passband = 5")])


@register("lagged_product", rounded(_LAG_SQL, keys=("object_id", "base", "target", "lag", "rank")))
def q_lagged_product(spark, sf_dir):
    """full correlation of day-bucket means of bands 0..4 with band 5, top 3 lags per object and pair."""
    return spectral.lagged_product(lc_events(spark, sf_dir))
