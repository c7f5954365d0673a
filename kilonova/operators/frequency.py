"""Periodograms from moment cells (F8, C10) and the frequency set.

**Periodogram.**  The frequencies of ``span_grid`` are whole multiples of its step, so all sums of the generalised
Lomb-Scargle power are values of Fourier transforms over time.  Time is cut into cells of 1 / (16 f_max); a cell keeps
moments of the weights and the weighted values around its middle, which is a mergeable aggregate: the shuffle carries one
row per (series, occupied cell), however many frequencies are asked for, and a series that holds most of the table is
at most its span's number of cells when its transforms are taken.  The Taylor series of the phase within a cell is cut
where its rest is below 1e-13.

**Harmonic fit.**  Constant and four harmonics by weighted least squares: the normal matrix is made of sums of cos(k phi)
and sin(k phi), k up to 8, again mergeable; it is solved per series in the JVM by elimination with pivots on the
diagonal (the matrix is symmetric and positive definite), with a ridge on the harmonics chosen by generalised
cross-validation.  Prewhitening subtracts the fit from the rows and starts anew; rows and fits of a round are checkpointed.

**Folded order.**  Steps along phase at P and 2P are circular: the first point's predecessor is the last one.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import BAND_LETTERS, BANDS, safe_div
from ..functions.quantiles import aggregate_with_medians, exact_quantiles
from ..functions.slices import measured, stored
from ..functions.windows import circular_lag_columns, join_back, keeps_whole, lag_columns
from ..session import ensure_checkpoint_dir
from .series import SERIES
from .stats import restore_objects

TIE_BITS = 20
#: cells per cycle of the highest frequency; moments of the weights (used up to twice that frequency) and the values
CELLS = 16
W_MOMENTS, Y_MOMENTS = 12, 10
#: below these shares the spread of the values or the determinant is rounding, and the power is undefined
FLAT, SINGULAR = 1e-12, 1e-9


def span_grid(lc: DataFrame, f_max: float = 10.0, oversampling: int = 5) -> tuple[float, float, int]:
    """(first frequency, step, number) from one cycle in the table's time span T to ``f_max`` a day.  A peak is about 1/T
    wide; the step is that width over ``oversampling``, so no peak falls between grid points."""
    lo, hi = lc.agg(F.min("mjd"), F.max("mjd")).first()   # two numbers
    if hi is None or hi <= lo:
        return f_max / 100, f_max / 100, 100
    first, step = 1.0 / (hi - lo), 1.0 / (oversampling * (hi - lo))
    return first, step, max(1, math.floor((f_max - first) / step) + 1)


def moment_cells(rows: DataFrame, width: float) -> DataFrame:
    """Per (object, band, cell): n, arrays w and y of moments (around the cell's middle in units of its width) and yy, from
    rows with t, y and w."""
    at = rows.filter("t IS NOT NULL AND y IS NOT NULL AND w IS NOT NULL").withColumn("cell", F.floor(F.col("t") / F.lit(width)))
    at = at.withColumn("u", F.col("t") / F.lit(width) - F.col("cell") - F.lit(0.5)).withColumn("wy", F.col("w") * F.col("y"))
    power = [" * ".join(["{}"] + ["u"] * k) for k in range(W_MOMENTS)]
    sums = [f"sum({p.format('w')}) AS w_{k}" for k, p in enumerate(power)]
    sums += [f"sum({p.format('wy')}) AS y_{k}" for k, p in enumerate(power[:Y_MOMENTS])]
    out = at.groupBy(*SERIES, "cell").agg(F.count(F.lit(1)).alias("n"), *map(F.expr, sums), F.expr("sum(wy * y) AS yy"))
    return out.select(*SERIES, "cell", "n", "yy", F.array(*[f"w_{k}" for k in range(W_MOMENTS)]).alias("w"),
                      F.array(*[f"y_{k}" for k in range(Y_MOMENTS)]).alias("y"))


def _by(cells: DataFrame, *keys: str):
    """Groups dealt over all tasks: the transforms cost far more than the bytes that a small exchange is coalesced by."""
    return cells.repartition(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).groupBy(*keys)


def _transforms(cells: np.ndarray, moments: list[np.ndarray], size: int, at: list[np.ndarray]) -> list[np.ndarray]:
    """Sums of weight times e^(2 pi i f t) at the multiples of the step in each array of ``at``."""
    thetas = [2 * np.pi / size * f for f in at]
    outs, factors = [np.zeros(len(f), complex) for f in at], [np.ones(len(f), complex) for f in at]
    for k, m in enumerate(moments):
        spectrum = np.conj(np.fft.rfft(np.bincount(cells % size, m, size)))
        for i, f in enumerate(at):
            if k:
                factors[i] = factors[i] * (1j * thetas[i] / k)
            outs[i] += factors[i] * spectrum[f]
    return [out * np.exp(0.5j * theta) for out, theta in zip(outs, thetas)]


def _direct(cells: np.ndarray, w: np.ndarray, y: np.ndarray, size: int, freqs: np.ndarray) -> list[np.ndarray]:
    """The sums of ``_transforms`` (weights at ``freqs`` and twice them, values at ``freqs``) cell by cell."""
    out = [np.empty(len(freqs), complex) for _ in range(3)]
    for lo in range(0, len(freqs), 4096):
        theta = 2 * np.pi / size * freqs[lo:lo + 4096, None]
        once = np.exp(1j * theta * (cells + 0.5))
        for i, (wave, angle, m) in enumerate(((once, theta, w), (once * once, 2 * theta, w), (once, theta, y))):
            k = np.arange(1, len(m))
            taylor = np.cumprod(np.concatenate([np.ones((len(theta), 1)), 1j * angle / k], axis=1), axis=1)
            out[i][lo:lo + 4096] = ((wave @ m.T) * taylor).sum(1)
    return out


#: up to so many occupied cells, summing them one by one is cheaper than the transforms of all cells
FEW = 200


#: up to so many points, a series' sums are products of two short tables of waves; more points are put into cells
FEW_POINTS = 2000


def _point_sums(t: np.ndarray, w: np.ndarray, y: np.ndarray, df: float, first: int, n_freq: int) -> list[np.ndarray]:
    """The sums of ``_transforms`` from points: the wave of frequency (first + block * i + j) df is that of (first + block * i) df
    times that of j df, so all frequencies are one matrix product."""
    block = math.isqrt(n_freq - 1) + 1
    turn = 2j * np.pi * df * t
    low, high = np.exp(np.outer(np.arange(block), turn)).T, np.exp(np.outer(first + block * np.arange(-(-n_freq // block)), turn))
    return [x.ravel()[:n_freq] for x in ((high * w) @ low, (high * high * w) @ (low * low), (high * (w * y)) @ low)]


def _point_power(t: np.ndarray, w: np.ndarray, y: np.ndarray, grid: tuple[float, float, int]) -> np.ndarray:
    """``_power`` of a series given by its points; weights and values need not be scaled."""
    f_min, df, n_freq = grid
    total, first = w.sum(), round(f_min / df)
    if len(t) < 3 or not total > 0:
        return np.full(n_freq, np.nan)
    w = w / total
    if len(t) <= FEW_POINTS:
        one, two, val = _point_sums(t, w, y, df, first, n_freq)
    else:
        size, width, _ = _grid_sizes(f_min + (n_freq - 1) * df, df, f_min)
        cells = np.floor(t / width).astype(np.int64)
        u, freqs = t / width - cells - 0.5, first + np.arange(n_freq)
        (one, two), (val,) = (_transforms(cells, _moments_of(m, u, k), size, at) for m, k, at in (
            (w, W_MOMENTS, [freqs, 2 * freqs]), (w * y, Y_MOMENTS, [freqs])))
    return _power_of_sums(one, two, val, (w * y).sum(), (w * y * y).sum())


def _moments_of(m: np.ndarray, u: np.ndarray, k: int):
    """``m`` times the powers of ``u`` below the ``k``-th, one at a time."""
    for _ in range(k):
        yield m
        m = m * u


def _power(part: pa.Table, size: int, first: int, n_freq: int) -> np.ndarray:
    """Generalised Lomb-Scargle power of one series at the grid's frequencies (NaN: undefined)."""
    get = lambda c: part.column(c).to_numpy()
    cells, n = get("cell").astype(np.int64), get("n").sum()
    moments = lambda c, k: part.column(c).combine_chunks().flatten().to_numpy().reshape(-1, k).T
    w, y = moments("w", W_MOMENTS), moments("y", Y_MOMENTS)
    total, yy0 = w[0].sum(), get("yy").sum()
    freqs = first + np.arange(n_freq)
    if n < 3 or not total > 0:
        return np.full(n_freq, np.nan)
    w, y = w / total, y / total
    if len(cells) <= FEW:
        one, two, val = _direct(cells, w, y, size, freqs)
    else:
        (one, two), (val,) = _transforms(cells, w, size, [freqs, 2 * freqs]), _transforms(cells, y, size, [freqs])
    return _power_of_sums(one, two, val, y[0].sum(), yy0 / total)


def _power_of_sums(one: np.ndarray, two: np.ndarray, val: np.ndarray, mean: float, square: float) -> np.ndarray:
    """Power from the sums of a series of total weight 1, its mean and mean square."""
    c, s = one.real, one.imag
    yc, ys = val.real - mean * c, val.imag - mean * s
    cc, ss, cs = (1 + two.real) / 2 - c * c, (1 - two.real) / 2 - s * s, two.imag / 2 - c * s
    var, det = square - mean * mean, cc * ss - cs * cs
    if not var > FLAT * square:
        return np.full(len(one), np.nan)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(det > SINGULAR, (ss * yc * yc + cc * ys * ys - 2 * cs * yc * ys) / (var * det), np.nan)


def _snapped(x: np.ndarray, bits: int = TIE_BITS) -> np.ndarray:
    scale = np.exp2(np.minimum(bits - np.floor(np.log2(np.maximum(np.abs(x), 1e-300))), 30))
    return np.rint(x * scale) / scale


def _best(power: np.ndarray, f_min: float, df: float):
    """(frequency, power) of the largest power, the smallest frequency on ties; None without any."""
    known = np.flatnonzero(~np.isnan(power))
    if not len(known):
        return None
    k = known[np.argmax(_snapped(power[known]))]
    return f_min + int(k) * df, float(np.nanmax(power))


def _grid_sizes(f_max: float, df: float, f_min: float) -> tuple[int, float, int]:
    """Cells of a period 1 / df (a product of 2, 3 and 5, which transforms are fast on), their width, and the first
    frequency in steps."""
    least = math.ceil(CELLS * (f_max + 2 * df) / df)
    size = min(2 * p3 * p5 * (1 << max(0, (-(-least // (2 * p3 * p5)) - 1).bit_length())) for p3 in (3 ** i for i in range(12)) for p5 in (5 ** i for i in range(8)))
    return size, 1.0 / (df * size), round(f_min / df)


def weighted_rows(lc: DataFrame, origin: float) -> DataFrame:
    """Rows with t (from ``origin``), y and w = 1 / error^2."""
    w = F.pow(safe_div(F.lit(1.0), F.col("flux_err")), 2)
    return lc.select(*SERIES, (F.col("mjd") - F.lit(origin)).alias("t"), F.col("flux").alias("y"), w.alias("w"))


def series_peaks(rows: DataFrame, grid: tuple[float, float, int]) -> DataFrame:
    """object_id, passband, freq_best, power_max, n of every series with a defined power.  Small objects hand their points to
    one call each; else cells are summed before the exchange."""
    if keeps_whole(rows, ["object_id"]):
        return _whole_peaks(rows, grid)
    f_min, df, n_freq = grid
    size, width, first = _grid_sizes(f_min + (n_freq - 1) * df, df, f_min)

    def peak(part: pa.Table) -> pa.Table:
        best = _best(_power(part, size, first, n_freq), f_min, df)
        keys = [part.column(k).slice(0, 1 if best else 0) for k in SERIES]
        n = [int(part.column("n").to_numpy().sum())] if best else []
        return pa.table([*keys, pa.array([best[0]] if best else [], pa.float64()), pa.array([best[1]] if best else [], pa.float64()),
                         pa.array(n, pa.int64())], names=[*SERIES, "freq_best", "power_max", "n"])

    return _by(moment_cells(rows, width), *SERIES).applyInArrow(
        peak, "object_id long, passband int, freq_best double, power_max double, n long")


def _whole_peaks(rows: DataFrame, grid: tuple[float, float, int]) -> DataFrame:
    """``series_peaks`` of small objects: all bands of an object in one call."""
    f_min, df, _ = grid

    def peaks(part: pa.Table) -> pa.Table:
        band = part.column("passband").combine_chunks().dictionary_encode(null_encoding="encode")
        code, (t, w, y) = band.indices.to_numpy(), (part.column(c).to_numpy() for c in "twy")
        found = []
        for b in range(len(band.dictionary)):
            at = np.flatnonzero(code == b)
            if best := _best(_point_power(t[at], w[at], y[at], grid), f_min, df):
                found.append((at[0], *best, len(at)))
        first, freq, power, n = zip(*found) if found else ((), (), (), ())
        keys = part.select(SERIES).take(pa.array(first, pa.int64()))
        return pa.table([*keys.columns, pa.array(freq, pa.float64()), pa.array(power, pa.float64()), pa.array(n, pa.int64())],
                        names=[*SERIES, "freq_best", "power_max", "n"])

    points = rows.filter("t IS NOT NULL AND y IS NOT NULL AND w IS NOT NULL").select(*SERIES, "t", "y", "w")
    return _by(points, "object_id").applyInArrow(peaks, "object_id long, passband int, freq_best double, power_max double, n long")


def _keyed(lc: DataFrame) -> DataFrame:
    types = {"object_id": "bigint", "passband": "int"}   # a cast column loses what is known of its keys
    return lc.withColumns({k: F.col(k).cast(t) for k, t in types.items() if t != dict(lc.dtypes)[k]})


def _origin(lc: DataFrame) -> float:
    return lc.agg(F.min("mjd")).first()[0] or 0.0


def periodogram_peaks(lc: DataFrame, ids: DataFrame | None = None, f_max: float = 10.0, oversampling: int = 5) -> DataFrame:
    """Best frequency, its period and power per (object, band) on the span's grid (smallest frequency on
    ties)."""
    lc = _keyed(lc)
    best = series_peaks(weighted_rows(lc, _origin(lc)), span_grid(lc, f_max, oversampling))
    return best.select(*SERIES, "freq_best", "power_max", (F.lit(1.0) / F.col("freq_best")).alias("period_fast"))


def multiband_periodogram(lc: DataFrame, ids: DataFrame | None = None, f_max: float = 10.0, oversampling: int = 5) -> DataFrame:
    """F8 (multiband): power summed over the bands with a defined one, best frequency per object."""
    lc = _keyed(lc)
    f_min, df, n_freq = span_grid(lc, f_max, oversampling)
    size, width, first = _grid_sizes(f_min + (n_freq - 1) * df, df, f_min)

    def peak(part: pa.Table) -> pa.Table:
        bands, total = part.column("passband").to_numpy(), np.full(n_freq, np.nan)
        for b in np.unique(bands):
            p = _power(part.filter(pa.array(bands == b)), size, first, n_freq)
            total = np.where(np.isnan(total), p, np.where(np.isnan(p), total, total + p))
        best = _best(total, f_min, df)
        row = [[part.column("object_id")[0].as_py()], [best[0]], [best[1]]] if best else [[], [], []]
        return pa.table([pa.array(v, t) for v, t in zip(row, (pa.int64(), pa.float64(), pa.float64()))], names=["object_id", "freq_best", "power_max"])

    best = _by(moment_cells(weighted_rows(lc, _origin(lc)), width), "object_id").applyInArrow(
        peak, "object_id long, freq_best double, power_max double")
    return restore_objects(best.withColumn("period_fast", F.lit(1.0) / F.col("freq_best")), ids)


# -- harmonic fit (C22, C23) ---------------------------------------------------------------------------------------

HARMONICS = 4
SIZE = 2 * HARMONICS + 1
#: points a fit needs
LEAST = 2 * SIZE
#: ridge on the harmonics, in units of the weights' sum; generalised cross-validation chooses
RIDGES = (1e-6, 1e-4, 1e-2, 1.0)
TAU = 2 * math.pi


def _normal_matrix() -> str:
    """SQL text of the augmented normal matrix: rows of [matrix | right side], from sums C0.., S0.., Y0, YC1, YS1, .."""
    kind = ["1"] + [f"{f}{h}" for h in range(1, HARMONICS + 1) for f in "cs"]

    def cell(a: str, b: str) -> str:
        if a == "1" and b == "1":
            return "1D"
        if "1" in (a, b):
            f = a if b == "1" else b
            return f"{f[0].upper()}{f[1:]}"
        i, j = int(a[1:]), int(b[1:])
        c = lambda k: "1D" if k == 0 else f"C{abs(k)}"
        s = lambda k: "0D" if k == 0 else f"S{k}" if k > 0 else f"-S{-k}"
        if a[0] == b[0]:
            return f"({c(i - j)} {'+' if a[0] == 'c' else '-'} {c(i + j)}) / 2"
        if a[0] == "s":
            i, j = j, i   # cos i, sin j
        return f"({s(i + j)} + ({s(j - i)})) / 2"

    right = ["Y0"] + [f"Y{f.upper()}{h}" for h in range(1, HARMONICS + 1) for f in "cs"]
    return "array(" + ", ".join("array(" + ", ".join([*(cell(a, b) for b in kind), r]) + ")" for a, r in zip(kind, right)) + ")"


def harmonic_fit(rows: DataFrame, freqs: DataFrame, freq: str = "freq_best") -> DataFrame:
    """Per (object, band) with at least ``LEAST`` points: freq, lambda, c (constant), a1, b1, .. a4, b4 (cos and sin
    coefficients) of the fit at the series' frequency.  ``rows`` with t, y, w."""
    at = join_back(rows, freqs.select(*SERIES, F.col(freq).alias("f")), SERIES).filter("f IS NOT NULL AND w IS NOT NULL AND y IS NOT NULL")
    at = at.withColumn("p", F.lit(TAU) * F.col("f") * F.col("t"))
    trig = [f"sum(w * {fn}({k} * p)) / sum(w) AS {n}{k}" for k in range(1, 2 * HARMONICS + 1) for fn, n in (("cos", "C"), ("sin", "S"))]
    trig += [f"sum(w * y * {fn}({k} * p)) / sum(w) AS {n}{k}" for k in range(1, HARMONICS + 1) for fn, n in (("cos", "YC"), ("sin", "YS"))]
    sums = at.groupBy(*SERIES).agg(F.first("f").alias("freq"), F.count(F.lit(1)).alias("n"), F.expr("sum(w * y) / sum(w) AS Y0"),
                                   F.expr("sum(w * y * y) / sum(w) AS YY"), *map(F.expr, trig)).filter(F.col("n") >= LEAST)
    fit = sums.selectExpr(*SERIES, "freq", "n", "YY", f"{_normal_matrix()} AS m", f"explode(array({', '.join(f'{r!r}D' for r in RIDGES)})) AS lambda")
    # [matrix + ridge | right side | matrix's inverse in the making]
    fit = fit.withColumn("b", F.expr(f"transform(m, r -> r[{SIZE}])"))
    unit = f"transform(sequence(0, {SIZE - 1}), j -> CASE WHEN i = j THEN 1D ELSE 0D END)"
    ridge = "transform(r, (x, j) -> CASE WHEN i = j AND i > 0 THEN x + lambda ELSE x END)"
    fit = fit.withColumn("m", F.expr(f"transform(m, (r, i) -> concat({ridge}, {unit}))"))
    for k in range(SIZE):
        # named once, so that a step is not written into the next
        fit = fit.withColumn("m", F.expr(f"transform(m, (r, i) -> CASE WHEN i = {k} THEN r ELSE "
                                         f"zip_with(r, m[{k}], (x, y) -> x - y * (r[{k}] / m[{k}][{k}])) END)"))
    fit = fit.withColumn("x", F.expr(f"transform(m, (r, i) -> r[{SIZE}] / r[i])"))
    fit = fit.withColumn("trace", F.expr(f"{SIZE} - lambda * aggregate(sequence(1, {SIZE - 1}), 0D, (s, i) -> s + m[i][{SIZE + 1} + i] / m[i][i])"))
    fit = fit.withColumn("rss", F.expr(f"YY - aggregate(zip_with(x, b, (u, v) -> u * v), 0D, (s, v) -> s + v) "
                                       f"- lambda * aggregate(slice(x, 2, {SIZE - 1}), 0D, (s, v) -> s + v * v)"))
    fit = fit.withColumn("gcv", F.expr("rss / pow(1 - trace / n, 2)"))
    names = ["c"] + [f"{f}{h}" for h in range(1, HARMONICS + 1) for f in "ab"]
    best = fit.groupBy(*SERIES).agg(F.expr("min_by(struct(freq, lambda, x, n), struct(round(gcv / nullif(YY, 0), 6), lambda)) AS g"))
    return best.selectExpr(*SERIES, "g.freq AS freq", "g.n AS n", "g.lambda AS lambda", *[f"g.x[{i}] AS {n}" for i, n in enumerate(names)])


MODEL = "c + " + " + ".join(f"a{h} * cos({h} * {TAU!r}D * freq * t) + b{h} * sin({h} * {TAU!r}D * freq * t)" for h in range(1, HARMONICS + 1))


def subtract_fit(rows: DataFrame, fit: DataFrame) -> DataFrame:
    """Rows of the fitted series, y less the fitted curve."""
    at = join_back(rows, fit, SERIES).filter("freq IS NOT NULL")
    return at.selectExpr(*SERIES, "t", f"y - ({MODEL}) AS y", "w")


def line_fit(rows: DataFrame) -> DataFrame:
    """Per series: slope and intercept of the weighted least-squares line (slope NULL at a single time)."""
    s = {"T": "w * t", "Y": "w * y", "TT": "w * t * t", "TY": "w * t * y"}
    sums = rows.filter("w IS NOT NULL AND y IS NOT NULL").groupBy(*SERIES).agg(
        *[F.expr(f"sum({x}) / sum(w) AS {n}") for n, x in s.items()], (F.max("t") > F.min("t")).alias("spread"))
    sums = sums.withColumn("slope", F.expr("CASE WHEN spread THEN (TY - T * Y) / (TT - T * T) END"))
    return sums.selectExpr(*SERIES, "slope", "Y - slope * T AS intercept")


# -- the frequency set ---------------------------------------------------------------------------------------------

# Fixed names that must equal the reference's for right results.
FREQUENCY = ["fold2P_slope_10percentile", "fold2P_slope_90percentile", "freq1_amplitude1", "freq1_amplitude2",
             "freq1_amplitude3", "freq1_amplitude4", "freq1_freq", "freq1_lambda", "freq1_rel_phase2", "freq1_rel_phase3",
             "freq1_rel_phase4", "freq1_signif", "freq2_amplitude1", "freq2_amplitude2", "freq2_amplitude3",
             "freq2_amplitude4", "freq2_freq", "freq2_rel_phase2", "freq2_rel_phase3", "freq2_rel_phase4",
             "freq3_amplitude1", "freq3_amplitude2", "freq3_amplitude3", "freq3_amplitude4", "freq3_freq",
             "freq3_rel_phase2", "freq3_rel_phase3", "freq3_rel_phase4", "freq_amplitude_ratio_21",
             "freq_amplitude_ratio_31", "freq_frequency_ratio_21", "freq_frequency_ratio_31", "freq_model_max_delta_mags",
             "freq_model_min_delta_mags", "freq_model_phi1_phi2", "freq_n_alias", "freq_signif_ratio_21",
             "freq_signif_ratio_31", "freq_varrat", "freq_y_offset", "linear_trend", "medperc90_2p_p", "p2p_scatter_2praw",
             "p2p_scatter_over_mad", "p2p_scatter_pfold_over_mad", "p2p_ssqr_diff_over_var", "scatter_res_raw"]

CURVE = 100  # phases at which the fitted curve is looked at
ALIASES = (1.0, 1 / 2, 1 / 3, 1 / 4)  # days; a period within half a percent of one counts


def curve_features() -> dict[str, str]:
    """C25 as SQL text over ``v``, the fitted curve at ``CURVE`` phases of its period (highs and lows: circular)."""
    high = f"filter(sequence(0, {CURVE - 1}), i -> v[i] > v[pmod(i - 1, {CURVE})] AND v[i] >= v[pmod(i + 1, {CURVE})])"
    low = high.replace("v[i] >", "v[i] <")
    gap = f"pmod(array_position(v, array_max(v)) - array_position(v, array_min(v)), {CURVE}) / {CURVE}D"
    return {
        "highs": f"sort_array(transform({high}, i -> v[i]), false)", "lows": f"sort_array(transform({low}, i -> v[i]))",
        "gap": gap,
    }


def _relative(h: int) -> str:
    """Phase of harmonic ``h`` against the first one, in (-pi, pi]."""
    x = f"(atan2(b{h}, a{h}) - {h} * atan2(b1, a1))"
    return f"{x} - {TAU!r}D * ceil({x} / {TAU!r}D - 0.5D)"


def series_frequency_long(lc: DataFrame, f_max: float = 10.0, oversampling: int = 5) -> DataFrame:
    """C21-C27 per (object, band), long form; series of fewer than ``LEAST`` usable points have no row."""
    ensure_checkpoint_dir(lc.sparkSession)
    lc = _keyed(lc)
    grid = span_grid(lc, f_max, oversampling)
    raw = weighted_rows(lc, _origin(lc)).filter("t IS NOT NULL AND y IS NOT NULL AND w IS NOT NULL").checkpoint()
    raw = measured(raw, SERIES)
    trend = line_fit(raw).filter("slope IS NOT NULL").checkpoint()
    rows = join_back(raw, trend, SERIES).filter("slope IS NOT NULL").selectExpr(*SERIES, "t", "y - intercept - slope * t AS y", "w").checkpoint()
    flat, fits, squares = rows, [], []
    for i in (1, 2, 3):
        peaks = series_peaks(rows, grid)
        fit = join_back(harmonic_fit(rows, peaks), peaks.select(*SERIES, "power_max"), SERIES).checkpoint()
        if i < 3:
            rows = subtract_fit(rows, fit).checkpoint()
            squares.append(rows)
        fits.append(fit)
    out = trend.select(*SERIES, F.col("slope").alias("linear_trend"))
    for i, fit in enumerate(fits, 1):
        amps = [f"sqrt(a{h} * a{h} + b{h} * b{h}) AS freq{i}_amplitude{h}" for h in range(1, HARMONICS + 1)]
        rel = [f"{_relative(h)} AS freq{i}_rel_phase{h}" for h in range(2, HARMONICS + 1)]
        signif = f"CASE WHEN power_max < 1 THEN -(n - 3) / 2D * log10(1 - power_max) END AS signif{i}"
        out = join_back(out, fit.selectExpr(*SERIES, f"freq AS freq{i}_freq", *amps, *rel, signif), SERIES)
    first = fits[0].selectExpr(*SERIES, "lambda AS freq1_lambda", "c AS freq_y_offset", f"transform(sequence(0, {CURVE - 1}), i -> "
                               + " + ".join(f"a{h} * cos({h} * {TAU / CURVE!r}D * i) + b{h} * sin({h} * {TAU / CURVE!r}D * i)" for h in range(1, HARMONICS + 1)) + ") AS v")
    first = first.withColumns({n: F.expr(e) for n, e in curve_features().items()}).selectExpr(
        *SERIES, "freq1_lambda", "freq_y_offset", "get(highs, 0) - get(highs, 1) AS freq_model_max_delta_mags",
        "get(lows, 1) - get(lows, 0) AS freq_model_min_delta_mags", "try_divide(gap, 1 - gap) AS freq_model_phi1_phi2")
    out = join_back(out, first, SERIES).filter("freq1_freq IS NOT NULL")
    spread = lambda df, n: df.groupBy(*SERIES).agg(F.expr(f"sum(w * y * y) / sum(w) - pow(sum(w * y) / sum(w), 2) AS {n}"))
    out = join_back(join_back(out, spread(flat, "_before"), SERIES), spread(squares[0], "_after"), SERIES)
    out = join_back(out, _folded(raw, flat, fits[0], squares[0]), SERIES)
    near = lambda i: f"CASE WHEN exists(array({', '.join(f'{p!r}D' for p in ALIASES)}), p -> abs(1 / freq{i}_freq - p) < 0.005 * p) THEN 1 ELSE 0 END"
    ratios = {f"freq_{what}_ratio_{i}1": f"try_divide({name.format(i)}, {name.format(1)})" for i in (2, 3)
              for what, name in (("amplitude", "freq{}_amplitude1"), ("frequency", "freq{}_freq"), ("signif", "signif{}"))}
    more = ratios | {"freq1_signif": "signif1", "freq_varrat": "try_divide(_after, _before)",
                     "freq_n_alias": f"CAST({near(1)} + {near(2)} + {near(3)} AS DOUBLE)"}
    return out.withColumns({n: F.expr(e) for n, e in more.items()}).select(*SERIES, *FREQUENCY)


def _folded(raw: DataFrame, flat: DataFrame, fit: DataFrame, left: DataFrame) -> DataFrame:
    """C26, C27 of the fitted series: steps in time and in folded order, and the residuals of the fits at P and 2P."""
    freq = fit.selectExpr(*SERIES, "freq AS f")
    rows = join_back(raw, freq, SERIES).filter("f IS NOT NULL").selectExpr(*SERIES, "t", "y", "f", "pmod(t * f, 1D) AS ph1", "pmod(t * f / 2, 1D) AS ph2")
    steps = stored(lag_columns(rows, SERIES, "t", ["y"], "_t_"), SERIES)
    steps = stored(circular_lag_columns(steps, SERIES, "ph1", ["y"], "_p_", ties=("t",)), SERIES)
    steps = stored(circular_lag_columns(steps, SERIES, "ph2", ["y", "ph2"], "_d_", ties=("t",)), SERIES)
    middle = stored(aggregate_with_medians(rows, SERIES, [F.var_pop("y").alias("_var"), F.count(F.lit(1)).alias("_n")], {"_med": ("y", None)}), SERIES)
    steps = join_back(steps, middle, SERIES).withColumns({
        "d0": F.expr("y - _t_y"), "d1": F.expr("y - _p_y"), "d2": F.expr("y - _d_y"),
        "slope": F.expr("try_divide(y - _d_y, pmod(ph2 - _d_ph2, 1D) * 2 / f)")})
    sums = aggregate_with_medians(steps, SERIES, [
        F.expr("try_divide(sum(d2 * d2), sum(d0 * d0)) AS p2p_scatter_2praw"),
        F.expr("try_divide(sum(d0 * d0) / (max(_n) - 1), max(_var)) AS p2p_ssqr_diff_over_var")],
        {"_m0": ("abs(d0)", None), "_m1": ("abs(d1)", None), "_mad": ("abs(y - _med)", None)})
    slopes = exact_quantiles(steps, SERIES, "slope", [0.1, 0.9], "_s")
    # the fit at 2P, on the same detrended rows
    double = stored(harmonic_fit(flat, fit.selectExpr(*SERIES, "freq / 2 AS half"), "half"), SERIES)
    far = exact_quantiles(subtract_fit(flat, double).withColumn("r", F.abs("y")), SERIES, "r", [0.9], "_two")
    near = exact_quantiles(left.withColumn("r", F.abs("y")), SERIES, "r", [0.9], "_p")
    rest = join_back(left, stored(aggregate_with_medians(left, SERIES, [], {"_rm": ("y", None)}), SERIES), SERIES)
    rest = aggregate_with_medians(rest, SERIES, [], {"_rmad": ("abs(y - _rm)", None)})
    for more in (slopes, far, near, rest):
        sums = join_back(sums, more, SERIES)
    return sums.selectExpr(*SERIES, "_s0 AS fold2P_slope_10percentile", "_s1 AS fold2P_slope_90percentile",
                           "try_divide(_two0, _p0) AS medperc90_2p_p", "p2p_scatter_2praw", "p2p_ssqr_diff_over_var",
                           "try_divide(_m0, _mad) AS p2p_scatter_over_mad", "try_divide(_m1, _mad) AS p2p_scatter_pfold_over_mad",
                           "try_divide(_rmad, _mad) AS scatter_res_raw")


def series_frequency(lc: DataFrame, ids: DataFrame | None = None, f_max: float = 10.0, oversampling: int = 5) -> DataFrame:
    """Frequency set, 47 features x 6 bands = 282 columns ``<feature>_<u..y>``."""
    # six aggregates of a struct of features, not one for each of the 282 columns
    long = series_frequency_long(lc, f_max, oversampling).select(*SERIES, F.struct(*FREQUENCY).alias("s"))
    by_band = long.groupBy("object_id").agg(*[F.expr(f"first(CASE WHEN passband = {b} THEN s END, true) AS s{b}") for b in BANDS])
    wide = by_band.select("object_id", *[F.col(f"s{b}")[n].alias(f"{n}_{x}") for n in FREQUENCY for b, x in zip(BANDS, BAND_LETTERS)])
    return restore_objects(wide, ids)
