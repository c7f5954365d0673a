"""Periodogram (F8, C10, C21 first term) and lag-correlation jobs.

The periodogram is the generalised (floating-mean, error-weighted)
Lomb-Scargle power.  Peaks on the grid that follows the time span come from
``frequency`` (transforms of moment cells).  ``periodogram_power`` gives the whole
spectrum on any grid as rows, by direct sums: every observation is expanded over
the frequencies (a fixed-size generator, not a join), nine weighted sums per
(object, band, frequency) are aggregated with map-side partial aggregation,
and the power is a closed form of those sums.  Work is O(rows x grid).

The interpolated cross-correlation places, for every lag of the grid, a probe
row at t1 + lag among the other band's points of the same object; the previous
and next real points come from windows per slice of time with carries between
the slices, so no pair of points is ever materialised.
"""
from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import safe_div, snap
from ..functions.windows import join_back, nearest_columns, running_sums
from ..session import ensure_checkpoint_dir
from . import frequency
from .buckets import bucket_pivot
from .frequency import TIE_BITS, span_grid
from .stats import restore_objects

# Peaks are chosen on values snapped to TIE_BITS significant bits, so candidates
# equal up to float noise (e.g. a 3-point series fits every frequency) tie and
# the smallest frequency / lag wins deterministically.


def frequency_grid(lc: DataFrame, f_max: float = 10.0, n: int = 100) -> tuple[float, float]:
    """(first frequency, step) of ``n`` evenly spaced frequencies from one cycle in the table's time span to ``f_max``
    a day."""
    lo, hi = lc.agg(F.min("mjd"), F.max("mjd")).first()   # two numbers
    first = 1.0 / (hi - lo) if hi is not None and hi > lo else f_max / n
    return first, (f_max - first) / (n - 1)


#: frequencies of a block; a row is expanded to blocks, a block to its frequencies
FREQ_BLOCK = 1000


def periodogram_power(lc: DataFrame, f_max: float = 10.0, n_freq: int | None = None, f_min: float | None = None,
                      df: float | None = None, oversampling: int = 5) -> DataFrame:
    """F8: GLS power per (object_id, passband, freq) on the grid of ``span_grid``; with ``n_freq``, on that of
    ``frequency_grid``, or on ``n_freq`` steps of ``df`` from ``f_min``."""
    if n_freq is None:
        f_min, df, n_freq = span_grid(lc, f_max, oversampling)
    elif f_min is None or df is None:
        f_min, df = frequency_grid(lc, f_max, n_freq)
    w = F.pow(safe_div(F.lit(1.0), F.col("flux_err")), 2)
    # expanded and summed on the map side: the shuffle carries one row of sums per (object, band, frequency) and task,
    # and a huge object is spread over all tasks
    rows = lc.select("object_id", "passband", "mjd", "flux", w.alias("w")).filter(F.col("w").isNotNull())
    size = min(n_freq, FREQ_BLOCK)
    blocks = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit((n_freq - 1) // size))).alias("block"))
    in_block = F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("i")
    ex = blocks.select("*", in_block).withColumn("k", F.col("block") * F.lit(size) + F.col("i")).filter(F.col("k") < n_freq)
    ex = ex.withColumn("freq", F.lit(f_min) + F.col("k") * F.lit(df))
    ph = F.lit(2 * math.pi) * F.col("freq") * F.col("mjd")
    ex = ex.withColumns({"c": F.cos(ph), "s": F.sin(ph)})
    y, wc = F.col("flux"), F.col("w")
    sums = ex.groupBy("object_id", "passband", "freq").agg(
        F.sum(wc).alias("W"), F.sum(wc * y).alias("Y"), F.sum(wc * F.col("c")).alias("C"),
        F.sum(wc * F.col("s")).alias("S"), F.sum(wc * y * y).alias("YY_"), F.sum(wc * y * F.col("c")).alias("YC_"),
        F.sum(wc * y * F.col("s")).alias("YS_"), F.sum(wc * F.col("c") * F.col("c")).alias("CC_"),
        F.sum(wc * F.col("s") * F.col("s")).alias("SS_"), F.sum(wc * F.col("c") * F.col("s")).alias("CS_"),
        F.count(F.lit(1)).alias("n"))
    # normalise weights to sum 1, centre the sums
    nw = {k: F.col(k) / F.col("W") for k in ("Y", "C", "S", "YY_", "YC_", "YS_", "CC_", "SS_", "CS_")}
    yy = nw["YY_"] - nw["Y"] * nw["Y"]
    yc = nw["YC_"] - nw["Y"] * nw["C"]
    ys = nw["YS_"] - nw["Y"] * nw["S"]
    cc = nw["CC_"] - nw["C"] * nw["C"]
    ss = nw["SS_"] - nw["S"] * nw["S"]
    cs = nw["CS_"] - nw["C"] * nw["S"]
    d = cc * ss - cs * cs
    power = safe_div(ss * yc * yc + cc * ys * ys - 2 * cs * yc * ys, yy * d)
    return sums.select("object_id", "passband", "freq", "n", F.when(F.col("n") >= 3, power).alias("power"))


def periodogram_peaks(lc: DataFrame, ids: DataFrame | None = None, **grid) -> DataFrame:
    """Best frequency, its period and power per (object, band) (smallest
    frequency on ties).  Without a grid of one's own, by transforms of moment cells (``frequency``)."""
    if not grid.keys() - {"f_max", "oversampling"}:
        return frequency.periodogram_peaks(lc, ids, **grid)
    p = periodogram_power(lc, **grid).filter(F.col("power").isNotNull())
    best = p.groupBy("object_id", "passband").agg(
        F.max_by("freq", F.struct(snap("power", TIE_BITS), -F.col("freq"))).alias("freq_best"),
        F.max("power").alias("power_max"))
    return best.withColumn("period_fast", safe_div(F.lit(1.0), F.col("freq_best")))


def multiband_periodogram(lc: DataFrame, ids: DataFrame | None = None, **grid) -> DataFrame:
    """F8 (multiband): power summed over bands per frequency, best frequency per object."""
    if not grid.keys() - {"f_max", "oversampling"}:
        return frequency.multiband_periodogram(lc, ids, **grid)
    p = periodogram_power(lc, **grid).filter(F.col("power").isNotNull())
    tot = p.groupBy("object_id", "freq").agg(F.sum("power").alias("power"))
    best = tot.groupBy("object_id").agg(
        F.max_by("freq", F.struct(snap("power", TIE_BITS), -F.col("freq"))).alias("freq_best"),
        F.max("power").alias("power_max"))
    return restore_objects(best.withColumn("period_fast", safe_div(F.lit(1.0), F.col("freq_best"))), ids)


def phase_fold(lc: DataFrame, period_col: str = "period") -> DataFrame:
    """F8: phase = (t / P) mod 1 for a per-row period column."""
    return lc.withColumn("phase", F.pmod(safe_div(F.col("mjd"), F.col(period_col)), F.lit(1.0)))


def lag_grid(lo: float, hi: float, step: float) -> list[float]:
    n = int(round((hi - lo) / step))
    return [lo + k * step for k in range(n + 1)]


def interpolated_pairs(lc: DataFrame, band1: int, band2: int, lags: list[float], carry: tuple[str, ...] = ()) -> DataFrame:
    """For each band1 point i and lag L, band2 linearly interpolated at t_i + L
    (only inside band2's time range).  Returns (object_id, lag, y1, y2) and the columns of band1's rows in ``carry``."""
    b1 = lc.filter((F.col("passband") == band1) & F.col("mjd").isNotNull())
    b2 = lc.filter((F.col("passband") == band2) & F.col("mjd").isNotNull() & F.col("flux").isNotNull())
    lag = F.explode(F.array(*[F.lit(float(v)) for v in lags])).alias("lag")
    probes = b1.select("object_id", F.col("mjd").alias("t1"), F.struct(F.col("flux").alias("y1"), *carry).alias("own"), lag)
    point = F.struct(F.col("mjd").alias("t"), F.col("flux").alias("y"))
    probes = probes.select("object_id", (F.col("t1") + F.col("lag")).alias("t"), F.lit(1).alias("kind"), "lag", "own")
    pts = b2.select("object_id", F.col("mjd").alias("t"), F.lit(0).alias("kind"), point.alias("p"))
    u = probes.unionByName(pts, allowMissingColumns=True).withMetadata("object_id", {})   # more rows than the table's bound
    # the latest point at or before a probe and the earliest at or after it (kind 0 before kind 1: a point at a probe's own
    # time counts on both sides); a huge object is worked on in slices of time
    u = nearest_columns(u, ["object_id"], "t", "kind", "p", "a", "b")
    q = u.filter("kind = 1 AND a IS NOT NULL AND b IS NOT NULL")
    y2 = "CASE WHEN b.t = a.t THEN a.y ELSE a.y + (b.y - a.y) * (t - a.t) / (b.t - a.t) END AS y2"
    return q.selectExpr("object_id", "lag", "own.y1 AS y1", y2, *[f"own.{c} AS {c}" for c in carry])


#: resampling: replicates, least peak correlation of a success, upper percentile (the lower one is its complement)
REPLICATES, LEAST_R, PERCENTILE = 100, 0.2, 0.841344746
#: below this share of the raw second moment a replicate's variance is rounding
FLAT = 1e-9


def _poisson_limits() -> list[int]:
    """Pieces below the k-th limit have a weight of at most k."""
    limits, p, upto = [], math.exp(-1), 0.0
    for k in range(8):
        upto += p
        limits.append(math.floor(upto * 65536))
        p /= k + 1
    return limits


def bootstrap_weights(key: str, replicates: int) -> str:
    """SQL text: array of Poisson(1) weights of a row, one per replicate, from 16-bit pieces of MD5 digests of its key."""
    digest = f"md5(concat({key}, ':', i))"
    piece = f"CAST(conv(substring({digest}, 1 + 4 * j, 4), 16, 10) AS INT)"
    weight = " + ".join(f"CAST({piece} >= {x} AS INT)" for x in _poisson_limits())
    pieces = f"transform(sequence(0, 7), j -> {weight.replace(piece, 'h[j]')})"
    many = f"transform(sequence(0, {-(-replicates // 8) - 1}), i -> transform(sequence(0, 7), j -> {piece}))"
    return f"slice(flatten(transform({many}, h -> {pieces})), 1, {replicates})"


def pearson(x: str, y: str) -> Column:
    """Pearson r over the rows that hold both columns; NULL where one of them has no spread (``corr`` divides by zero there,
    an error in ANSI mode)."""
    sx, sy = (F.stddev_pop(F.when(F.col(other).isNotNull(), F.col(c))) for c, other in ((x, y), (y, x)))
    return safe_div(F.covar_pop(x, y), sx * sy)


def _peaks_of(r: DataFrame, keys: list[str], centroid_frac: float) -> DataFrame:
    """Peak lag, its r, and the mean of the lags whose r is at least a share of it, per key."""
    peak = r.groupBy(*keys).agg(F.max_by("lag", F.struct(snap("r", TIE_BITS), -F.col("lag"))).alias("peak_lag"), F.max("r").alias("peak_r"),
                                F.collect_list(F.struct("lag", "r")).alias("_all"))   # one entry a lag of the grid
    high = F.filter("_all", lambda x: x["r"] >= F.col("peak_r") * centroid_frac)
    mean = F.aggregate(F.sort_array(F.transform(high, lambda x: x["lag"])), F.lit(0.0), lambda s, x: s + x) / F.size(high)
    return peak.select(*keys, "peak_lag", "peak_r", F.when(F.size(high) > 0, mean).alias("centroid_lag"), "_all")


def cross_correlation(lc: DataFrame, ids: DataFrame | None = None, band1: int = 1, band2: int = 5,
                      lo: float = -100.0, hi: float = 100.0, step: float = 10.0, centroid_frac: float = 0.8,
                      replicates: int = REPLICATES) -> DataFrame:
    """Pearson r per lag of band2 interpolated onto band1 shifted by the lag (columns r_lag_<k> for the grid, wide),
    peak lag / r, centroid lag (mean of lags with r >= centroid_frac * r_peak), and their errors by resampling.

    A replicate weights every band1 point by a Poisson(1) number drawn from a hash of object and time, so its correlations
    are mergeable sums; it succeeds if its peak r exceeds ``LEAST_R``.  centau, peaktau: medians over the successes;
    _uperr, _loerr: distance of the 84.13 and 15.87 percentiles from centau (for both, as the published feature has it);
    success_ratio: successes over replicates.  ``replicates=0`` leaves these out."""
    ensure_checkpoint_dir(lc.sparkSession)
    lags = lag_grid(lo, hi, step)
    key = "concat(object_id, ':', CAST(round(mjd * 86400000) AS BIGINT))"
    if replicates:
        pairs = interpolated_pairs(lc.withColumn("point", F.expr(key)), band1, band2, lags, ("point",)).checkpoint()
    else:
        pairs = interpolated_pairs(lc, band1, band2, lags)
    r = pairs.groupBy("object_id", "lag").agg(pearson("y1", "y2").alias("r"), F.count(F.lit(1)).alias("n_pairs"))
    r = r.filter(F.col("r").isNotNull() & ~F.isnan("r"))
    peak = _peaks_of(r, ["object_id"], centroid_frac)
    out = peak.selectExpr("object_id", "peak_lag", "peak_r", "centroid_lag",
                          *[f"get(filter(_all, x -> x.lag = {float(v)!r}D), 0).r AS r_lag_{i}" for i, v in enumerate(lags)])
    if replicates:
        out = out.join(_resampled(pairs, lags, centroid_frac, replicates), "object_id", "left")
    return restore_objects(out, ids)


#: pairs of an object that one task resamples; a larger object's points are dealt over parts, whose sums are added
PART_PAIRS = 100_000
RESAMPLED = ("centau double, centau_uperr double, centau_loerr double, peaktau double, peaktau_uperr double, peaktau_loerr double, "
             "success_ratio double")


def point_weights(points: list[str], replicates: int) -> np.ndarray:
    """The weights of ``bootstrap_weights``, one row a point."""
    n = -(-replicates // 8)
    digests = b"".join(hashlib.md5(f"{p}:{i}".encode()).digest() for p in points for i in range(n))
    pieces = np.frombuffer(digests, dtype=">u2").reshape(len(points), 8 * n)[:, :replicates]
    return np.searchsorted(_poisson_limits(), pieces, side="right").astype(np.float64)


def _replicate_sums(part: pa.Table, lags: list[float], replicates: int) -> np.ndarray:
    """Sums of k, kx, ky, kxx, kyy, kxy per lag and replicate (lags, 6, replicates) over one object's pairs; columns m1 and m2,
    if there, are the lags' means, else those of ``part``."""
    points = part.column("point").dictionary_encode().combine_chunks()
    weights, at = point_weights(points.dictionary.to_pylist(), replicates), points.indices.to_numpy()
    lag, y2 = part.column("lag").to_numpy(), part.column("y2").to_numpy()
    known = part.column("y1").is_valid().to_numpy()
    y1 = part.column("y1").fill_null(0.0).to_numpy()
    at_lag = np.searchsorted(lags, lag)
    if "m1" in part.column_names:
        m1, m2 = (part.column(c).fill_null(0.0).to_numpy() for c in ("m1", "m2"))
    else:
        n1, n2 = (np.maximum(np.bincount(at_lag, w, len(lags)), 1) for w in (known, np.ones(len(lag))))
        m1, m2 = (np.bincount(at_lag, np.where(known, y1, 0.0), len(lags)) / n1)[at_lag], (np.bincount(at_lag, y2, len(lags)) / n2)[at_lag]
    x, y = np.where(known, y1 - m1, 0.0), y2 - m2   # a pair without y1 counts in sum(k), as in SQL
    out, order = np.zeros((len(lags), 6, replicates)), np.argsort(at_lag, kind="stable")
    for lo in range(0, len(order), 10_000):
        rows = order[lo:lo + 10_000]
        here, starts = np.unique(at_lag[rows], return_index=True)
        k, a, b = weights[at[rows]], x[rows, None], y[rows, None]
        for j, f in enumerate((1.0, a, b, a * a, b * b, a * b)):
            out[here, j] += np.add.reduceat(k * f, starts)
    return out


def _replicate_errors(sums: np.ndarray, lags: list[float], centroid_frac: float) -> list[float | None]:
    """Values of ``RESAMPLED`` from the sums of an object."""
    with np.errstate(all="ignore"):
        mx, my, xx, yy, xy = (sums[:, j] / sums[:, 0] for j in range(1, 6))
        vx, vy = xx - mx * mx, yy - my * my
        r = np.where((sums[:, 0] > 0) & (vx > FLAT * xx) & (vy > FLAT * yy), (xy - mx * my) / np.sqrt(vx * vy), -np.inf)
    top, grid = r.max(axis=0), np.asarray(lags)
    good = top > LEAST_R
    share = good.mean()
    if not good.any():
        return [None] * 6 + [float(share)]
    r, top = r[:, good], top[good]
    snapped = np.where(np.isfinite(r), frequency._snapped(np.where(np.isfinite(r), r, 0.0)), -np.inf)
    peak = grid[snapped.argmax(axis=0)]   # the smallest lag on ties
    high = r >= top * centroid_frac
    centroid = (high * grid[:, None]).sum(axis=0) / high.sum(axis=0)
    q = [1 - PERCENTILE, 0.5, PERCENTILE]
    c, p = np.quantile(centroid, q), np.quantile(peak, q)
    return [float(v) for v in (c[1], c[2] - c[1], c[1] - c[0], p[1], p[2] - c[1], c[1] - p[0], share)]


def _resampled(pairs: DataFrame, lags: list[float], centroid_frac: float, replicates: int, part_pairs: int = PART_PAIRS) -> DataFrame:
    """Medians and errors of centroid and peak lag over bootstrap replicates, one row per object of ``pairs``.

    A task holds an object's pairs as matrices, weights of its points against the pairs' moments: no row per pair and
    replicate.  An object of more than ``part_pairs`` pairs is dealt by its points, and the sums of its parts are added."""
    of = pairs.schema["object_id"].dataType.simpleString()
    size = pairs.groupBy("object_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > part_pairs)
    size = size.select("object_id", F.ceil(F.col("_n") / part_pairs).cast("int").alias("_parts"))
    rows = join_back(pairs.filter("point IS NOT NULL"), size, ["object_id"])

    def key(part: pa.Table) -> pa.Array:
        return part.column("object_id").slice(0, 1).combine_chunks()

    def record(first: pa.Array, sums: np.ndarray) -> pa.Table:
        names = [c.split()[0] for c in RESAMPLED.split(", ")]
        values = _replicate_errors(sums, lags, centroid_frac)
        return pa.table([first, *[pa.array([v], pa.float64()) for v in values]], names=["object_id", *names])

    def whole(part: pa.Table) -> pa.Table:
        return record(key(part), _replicate_sums(part, lags, replicates))

    def piece(part: pa.Table) -> pa.Table:
        sums = _replicate_sums(part, lags, replicates)
        return pa.table([key(part), pa.array([sums.tobytes()], pa.binary())], names=["object_id", "sums"])

    def added(part: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(b.as_py()) for b in part.column("sums"))
        return record(key(part), sums.reshape(len(lags), 6, replicates))

    small = rows.filter("_parts IS NULL").select("object_id", "lag", "y1", "y2", "point")
    out = frequency._by(small, "object_id").applyInArrow(whole, f"object_id {of}, {RESAMPLED}")
    large = rows.filter("_parts IS NOT NULL").withColumn("_part", F.expr("pmod(xxhash64(point), _parts)"))
    # parts of one object are about its common means
    means = large.groupBy("object_id", "lag").agg(F.avg("y1").alias("m1"), F.avg("y2").alias("m2"))
    large = join_back(large, means, ["object_id", "lag"]).select("object_id", "_part", "lag", "y1", "y2", "point", "m1", "m2")
    parts = frequency._by(large, "object_id", "_part").applyInArrow(piece, f"object_id {of}, sums binary")
    return out.unionByName(parts.groupBy("object_id").applyInArrow(added, f"object_id {of}, {RESAMPLED}"))


#: half width of a gaussian lag slot in units of its kernel's width h = dt / 4: pairs beyond it fall under the threshold
GAUSS_REACH = 3.290527


def lag_slots(lo: float, hi: float, width: float, weighting: str = "slot") -> list[tuple[float, float, float]]:
    """(centre, from, to) of the lag bins.  Gaussian slots reach ``GAUSS_REACH`` kernel widths to both sides and overlap."""
    edges = lag_grid(lo, hi, width)
    slots = [((a + b) / 2, a, b) for a, b in zip(edges, edges[1:])]
    if weighting == "gauss":
        reach = GAUSS_REACH * width / 4
        slots = [(c, c - reach, c + reach) for c, _, _ in slots]
    return slots


def discrete_correlation(lc: DataFrame, ids: DataFrame | None = None, band1: int = 1, band2: int = 5,
                         lo: float = -10.0, hi: float = 10.0, bin_width: float = 2.0, weighting: str = "slot") -> DataFrame:
    """DCF per lag bin from pair sums that separate into
    per-point sums over a time range of the other band.

    For lag bin (a, b): pairs (i, j) with a < t2_j - t1_i < b.  Every needed
    pair sum is a sum over i of f(x_i) * G_i with G_i = sum of g(y_j) over band2
    points in (t1_i + a, t1_i + b); G_i is a difference of running sums at two
    probe rows, so no pair is materialised.  Running sums go from slice to slice
    of time, so a huge object is spread.  ``weighting="gauss"``: bins hold the
    pairs whose gaussian kernel value reaches the threshold (ends included); as
    in the published form the kernel selects pairs and doesn't weight them.
    """
    ensure_checkpoint_dir(lc.sparkSession)
    slots = lag_slots(lo, hi, bin_width, weighting)
    side = lambda band: lc.filter((F.col("passband") == band) & F.col("mjd").isNotNull() & F.col("flux").isNotNull() & F.col("flux_err").isNotNull())
    b1, b2 = side(band1), side(band2)
    # both bands around their object's means: sums of squares lose nothing, and the correlation knows no origin
    middle = lc.groupBy("object_id").agg(F.avg(F.when(F.col("passband") == band1, F.col("flux"))).alias("m1"),
                                         F.avg(F.when(F.col("passband") == band2, F.col("flux"))).alias("m2"))
    b1 = join_back(b1, middle, ["object_id"]).groupBy("object_id", F.col("mjd").alias("t1"), F.expr("flux - m1 AS x"), F.col("flux_err").alias("ex")) \
        .agg(F.count(F.lit(1)).alias("k"))   # equal points are one with a count
    b2 = join_back(b2, middle, ["object_id"]).selectExpr("object_id", "mjd AS t", "flux - m2 AS y", "flux_err AS ey", "1 AS kind")
    # probes: two per point and bin.  kind orders rows of one time: 0 before the points of band2, 2 behind them
    low, high = (0, 2) if weighting == "gauss" else (2, 0)
    ends = ", ".join(f"struct({i} AS bin, {e!r}D AS edge, {kind} AS kind, {sign}D AS sign)" for i, (_, a, b) in enumerate(slots)
                     for e, kind, sign in ((a, low, -1), (b, high, 1)))
    probes = b1.selectExpr("object_id", "struct(t1, x, ex, k) AS own", "t1", f"inline(array({ends}))")
    probes = probes.selectExpr("object_id", "t1 + edge AS t", "kind", "own", "bin", "sign")
    u = probes.unionByName(b2, allowMissingColumns=True).withMetadata("object_id", {})   # more rows than the table's bound
    u = running_sums(u, ["object_id"], "t", "kind",
                     {"c0": "CASE WHEN kind = 1 THEN 1D END", "c1": "y", "c2": "y * y", "ce": "ey"})
    # G over the range = running sums at its end less those at its beginning
    g = u.filter("kind != 1").groupBy("object_id", "bin", "own").agg(*[F.sum(F.col("sign") * F.col(c)).alias(n) for c, n in (
        ("c0", "n"), ("c1", "g1"), ("c2", "g2"), ("ce", "ge"))])
    g = g.filter("n > 0.5").selectExpr("object_id", "bin", "own.x AS x", "own.ex AS ex", "own.k AS k", "n", "g1", "g2", "ge").checkpoint()
    s = g.groupBy("object_id", "bin").agg(*[F.expr(f"sum(k * {e}) AS {n}") for n, e in (
        ("n", "n"), ("sx", "x * n"), ("sxx", "x * x * n"), ("sy", "g1"), ("syy", "g2"), ("sxy", "x * g1"), ("sex", "ex * n"), ("sey", "ge"))])
    s = s.selectExpr("object_id", "bin", "n", "sx / n AS mx", "sy / n AS my", "sxx / n AS xx", "syy / n AS yy", "sxy / n AS xy", "sex / n AS ex", "sey / n AS ey")
    prod = "(xx - mx * mx - ex * ex) * (yy - my * my - ey * ey)"   # undefined when the errors exceed the scatter
    s = s.withColumn("den", F.expr(f"CASE WHEN {prod} > 0 THEN sqrt({prod}) END")).withColumn("dcf", F.expr("try_divide(xy - mx * my, den)"))
    # squared deviations of the pairs' products, per point of band1: scatter of its partners about their mean, and that mean's
    # product against the bin's.  Neither is a small difference of large sums; one partner has no scatter.
    at = join_back(g, s.select("object_id", "bin", "mx", "my", "den", "dcf"), ["object_id", "bin"])
    dev = at.groupBy("object_id", "bin").agg(F.expr(
        "sum(k * (pow(x - mx, 2) * CASE WHEN n > 1.5 THEN greatest(g2 - g1 * g1 / n, 0D) ELSE 0D END "
        "+ n * pow((x - mx) * (g1 / n - my) - den * dcf, 2))) AS dev"))
    s = join_back(s, dev, ["object_id", "bin"])
    centers = f"array({', '.join(f'{c!r}D' for c, _, _ in slots)})"
    return s.selectExpr("object_id", "CAST(bin AS INT) AS bin", f"{centers}[bin] AS lag", "CAST(round(n) AS BIGINT) AS n_pairs", "dcf",
                        "try_divide(try_divide(sqrt(dev), den), n - 1) AS dcf_err")


def detrend(lc: DataFrame, bands: tuple[int, int] = (1, 5), degree: int = 0) -> DataFrame:
    """common time origin (min t over both bands of the object) and removal, per band, of the plain mean (degree 0)
    or the 1 / flux_err^2-weighted least-squares line (1) or parabola (2).  The fits are closed forms of sums, so they
    are mergeable aggregates; a series at a single time has no line or parabola (NULL).  Returns rows of the two bands with ``t0`` (time from the origin) and ``resid``."""
    rows = lc.filter(F.col("passband").isin(list(bands)))
    rows = join_back(rows, rows.groupBy("object_id").agg(F.min("mjd").alias("_t0")), ["object_id"])
    rows = rows.withColumns({"t0": F.col("mjd") - F.col("_t0"), "w": F.pow(safe_div(F.lit(1.0), F.col("flux_err")), 2)})
    keys = ["object_id", "passband"]
    if degree == 0:
        sums = rows.groupBy(*keys).agg(F.avg("flux").alias("_a"))
        fit = F.col("_a")
    else:
        t = [f"sum(w * pow(t0, {k})) AS _t{k}" for k in range(2 * degree + 1)]
        y = [f"sum(w * flux * pow(t0, {k})) AS _y{k}" for k in range(degree + 1)]
        sums = rows.groupBy(*keys).agg(*[F.expr(e) for e in t + y], F.min("t0").alias("_first"), F.max("t0").alias("_last"))
        if degree == 1:
            det = "(_t0 * _t2 - _t1 * _t1)"
            coef = [f"try_divide(_t2 * _y0 - _t1 * _y1, {det})", f"try_divide(_t0 * _y1 - _t1 * _y0, {det})"]
        else:  # cofactors of the symmetric 3 x 3 normal matrix
            m = {(0, 0): "(_t2 * _t4 - _t3 * _t3)", (0, 1): "(_t2 * _t3 - _t1 * _t4)", (0, 2): "(_t1 * _t3 - _t2 * _t2)",
                 (1, 1): "(_t0 * _t4 - _t2 * _t2)", (1, 2): "(_t1 * _t2 - _t0 * _t3)", (2, 2): "(_t0 * _t2 - _t1 * _t1)"}
            det = f"(_t0 * {m[0, 0]} + _t1 * {m[0, 1]} + _t2 * {m[0, 2]})"
            coef = [f"try_divide({' + '.join(f'{m[min(i, k), max(i, k)]} * _y{k}' for k in range(3))}, {det})" for i in range(3)]
        # one time alone fixes no slope (its determinant is zero but for rounding)
        sums = sums.select(*keys, *[F.expr(f"CASE WHEN _last > _first THEN {c} END").alias(f"_c{i}") for i, c in enumerate(coef)])
        fit = F.expr(" + ".join(f"_c{i} * pow(t0, {i})" for i in range(degree + 1)))
    return join_back(rows, sums, keys).select("object_id", "passband", "mjd", "t0", (F.col("flux") - fit).alias("resid"))


LAG_PAIRS = [(0, 5), (1, 5), (2, 5), (3, 5), (4, 5)]


def lagged_product(lc: DataFrame, width_days: float = 1.0, pairs=LAG_PAIRS, top: int = 3) -> DataFrame:
    """for each band pair, the two series of bucket means over the buckets that hold both bands, and their full
    correlation: xcorr[lag] = sum_n a[n + lag] * b[n] for every lag; the ``top`` lags per object and pair (smaller lag
    on ties).  A task gets two numbers a bucket, as many as the object's time span has, whatever its number of rows; all
    lags come from one product of transforms, and only the best ones leave the task."""
    by = bucket_pivot(lc, width_days)
    one = ", ".join(f"named_struct('base', {a}, 'target', {b}, 'x', flux_{a}, 'y', flux_{b})" for a, b in pairs)
    both = by.selectExpr("CAST(object_id AS BIGINT) AS object_id", "bucket", f"inline(array({one}))").filter("x IS NOT NULL AND y IS NOT NULL")

    def best(part: pa.Table) -> pa.Table:
        part = part.sort_by("bucket")
        x, y = part.column("x").to_numpy(), part.column("y").to_numpy()
        m = len(x)
        size = 1 << (2 * m - 1).bit_length()   # no lag wraps around
        xc = np.fft.irfft(np.fft.rfft(x, size) * np.conj(np.fft.rfft(y, size)), size)
        lags = np.arange(1 - m, m)
        xc = xc[lags]
        order = np.lexsort((lags, -frequency._snapped(xc)))[:top]
        n = len(order)
        keys = [pa.array([part.column(c)[0].as_py()] * n, t) for c, t in (("object_id", pa.int64()), ("base", pa.int32()), ("target", pa.int32()))]
        return pa.table([*keys, pa.array(lags[order].astype(np.int32)), pa.array(xc[order]), pa.array(np.arange(1, n + 1, dtype=np.int32))],
                        names=["object_id", "base", "target", "lag", "xcorr", "rank"])

    return frequency._by(both, "object_id", "base", "target").applyInArrow(
        best, "object_id long, base int, target int, lag int, xcorr double, rank int")
