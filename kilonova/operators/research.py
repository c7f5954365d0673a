"""Exploration / data-quality operators.

All of them are single-pass aggregates or window expressions; data-dependent
histogram edges are scalar subqueries (``DataFrame.scalar()``), evaluated once,
never a join or a driver round trip.  Tables joined by broadcast (class boxes,
bin edges) are bounded by construction (number of classes / bins).
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import BAND_LETTERS, BANDS, haversine, latlon1, pure_magnitude, safe_div
from ..functions.quantiles import aggregate_with_medians, exact_quantiles
from ..functions.windows import join_back, lag_columns
from .stats import restore_objects


def basic_meta(meta: DataFrame) -> DataFrame:
    """Photoz, photoz_err, distmod (NULL -> 0), mwebv, haversine, latlon1,
    photoz * exp(photoz_err)."""
    return meta.select(
        "object_id", "hostgal_photoz", "hostgal_photoz_err",
        F.coalesce(F.col("distmod"), F.lit(0.0)).alias("distmod"), "mwebv",
        haversine("ra", "decl", "gal_l", "gal_b").alias("haversine"),
        latlon1("ra", "decl", "gal_l", "gal_b").alias("latlon1"),
        (F.col("hostgal_photoz") * F.exp("hostgal_photoz_err")).alias("hostgal_photoz_certain"),
    )


def class_share_by_flag(meta: DataFrame, label: str = "target", flag: str = "ddf") -> DataFrame:
    """Per class, its share of the flag=0 and flag=1 populations.

    The column totals are one scalar subquery over the classes.
    """
    counts = meta.groupBy(label).agg(
        F.count(F.when(F.col(flag) == 0, 1)).alias("n_0"),
        F.count(F.when(F.col(flag) == 1, 1)).alias("n_1"))
    total = counts.agg(F.struct(F.sum("n_0").alias("n_0"), F.sum("n_1").alias("n_1"))).scalar()
    return counts.select(label, "n_0", "n_1", safe_div(F.col("n_0"), total["n_0"]).alias(f"ratio_{flag}0"),
                         safe_div(F.col("n_1"), total["n_1"]).alias(f"ratio_{flag}1"))


def crosstab(df: DataFrame, a: str, b: str, values: list) -> DataFrame:
    """Counts of (a, b) with b values as columns ``<b>_<value>``, missing -> 0."""
    out = df.groupBy(a).pivot(b, values).count().na.fill(0)
    return out.withColumnsRenamed({str(v): f"{b}_{v}" for v in values})


def null_report(df: DataFrame, key_free: bool = True) -> DataFrame:
    """Per column, number and share of NULLs (long form, one pass)."""
    cols = df.columns
    agg = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in cols])
    long = agg.select("_n", F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("n_null")) for c in cols])))
    return long.select("column", "n_null", safe_div(F.col("n_null"), F.col("_n")).alias("null_share"))


def max_series_length(lc: DataFrame) -> DataFrame:
    """Rows per (object, band), then per band the max length and the number of series."""
    sizes = lc.groupBy("object_id", "passband").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("passband").agg(F.max("n").alias("max_length"), F.count(F.lit(1)).alias("n_series"))


def series_length_distribution(lc: DataFrame) -> DataFrame:
    """G39 (distribution): number of series per (band, length)."""
    sizes = lc.groupBy("object_id", "passband").agg(F.count(F.lit(1)).alias("length"))
    return sizes.groupBy("passband", "length").agg(F.count(F.lit(1)).alias("n_series"))


def mean_by_detected(lc: DataFrame) -> DataFrame:
    """Mean flux / flux_err per (band, object, detected), then mean over objects per band."""
    per = lc.groupBy("passband", "object_id", "detected").agg(F.avg("flux").alias("f"), F.avg("flux_err").alias("e"))
    aggs = []
    for d in (0, 1):
        aggs += [F.avg(F.when(F.col("detected") == d, F.col("f"))).alias(f"flux_mean_detected{d}"),
                 F.avg(F.when(F.col("detected") == d, F.col("e"))).alias(f"flux_err_mean_detected{d}")]
    return per.groupBy("passband").agg(*aggs)


def duration_by_object(lc: DataFrame, meta: DataFrame) -> DataFrame:
    """Mjd max, min, span and flux_err min/max/mean/median per object, with target."""
    agg = aggregate_with_medians(lc, ["object_id"], [
        F.max("mjd").alias("mjd_max"), F.min("mjd").alias("mjd_min"),
        (F.max("mjd") - F.min("mjd")).alias("mjd_span"),
        F.min("flux_err").alias("flux_err_min"), F.max("flux_err").alias("flux_err_max"),
        F.avg("flux_err").alias("flux_err_mean")], {"flux_err_median": ("flux_err", None)})
    return meta.select("object_id", "target").join(agg, "object_id", "left")


def time_steps(lc: DataFrame) -> DataFrame:
    """Step to the previous observation of the same object (all bands, by time)."""
    rows = lag_columns(lc.select("object_id", "mjd", "passband"), ["object_id"], "mjd", ["mjd"], "_prev_", ties=("passband",))
    return rows.select("object_id", (F.col("mjd") - F.col("_prev_mjd")).alias("dt")).filter(F.col("dt").isNotNull())


def equal_width_histogram(df: DataFrame, col: str, bins: int = 100) -> DataFrame:
    """Histogram with ``bins`` equal bins over [min, max] of ``col`` (last bin closed).

    min / max are one scalar subquery of the same input."""
    ends = df.select(F.struct(F.min(col).alias("lo"), F.max(col).alias("hi"))).scalar()
    lo, hi = ends["lo"], ends["hi"]
    idx = F.least(F.floor((F.col(col) - lo) * F.lit(float(bins)) / (hi - lo)), F.lit(bins - 1)).cast("int")
    return (df.filter(F.col(col).isNotNull()).groupBy(F.coalesce(idx, F.lit(0)).alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"))
            .select("bin", (lo + F.col("bin") * (hi - lo) / bins).alias("bin_lo"), "n"))


def gap_histogram(lc: DataFrame, bins: int = 100) -> DataFrame:
    """Histogram of time steps between consecutive observations of an object."""
    return equal_width_histogram(time_steps(lc), "dt", bins)


def fixed_histogram(df: DataFrame, col: str, start: float, stop: float, step: float) -> DataFrame:
    """Counts in fixed bins [start + k*step, start + (k+1)*step), values outside dropped."""
    nb = int(round((stop - start) / step))
    idx = F.floor((F.col(col) - F.lit(start)) / F.lit(step)).cast("int")
    return (df.filter((F.col(col) >= start) & (F.col(col) < start + nb * step))
            .groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("n")))


def histogram2d(df: DataFrame, x: str, y: str, x_edges: list[float], y_bins: int) -> DataFrame:
    """G48 (2-D): irregular edges on x (right-open, last closed), equal bins on y over its range."""
    xs = F.array(*[F.lit(float(e)) for e in x_edges])
    # number of edges <= x, minus one = bin index
    xi = F.aggregate(xs, F.lit(0), lambda acc, e: acc + F.when(F.col(x) >= e, 1).otherwise(0)) - 1
    xi = F.when(F.col(x) == F.lit(float(x_edges[-1])), len(x_edges) - 2).otherwise(xi)
    ends = df.select(F.struct(F.min(y).alias("lo"), F.max(y).alias("hi"))).scalar()
    lo, hi = ends["lo"], ends["hi"]
    yi = F.least(F.floor((F.col(y) - lo) * F.lit(float(y_bins)) / (hi - lo)), F.lit(y_bins - 1)).cast("int")
    cells = df.select(xi.alias("x_bin"), F.coalesce(yi, F.lit(0)).alias("y_bin"))
    return (cells.filter((F.col("x_bin") >= 0) & (F.col("x_bin") < len(x_edges) - 1))
            .groupBy("x_bin", "y_bin").agg(F.count(F.lit(1)).alias("n")))


def lightcurve_summary(lc: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Per band weighted mean m = sum(f*(f/e)^2)/sum((f/e)^2), Std = std(f/e, ddof 1),
    Amp = (max - min)/m, MAD = median(|f - median(f)| / m), Beyond = share of
    |f - m| > std(f), Skew = population skew; colours of adjacent bands
    -2.5*log10(m_a/m_b) when both means are > 0, else -999.  35 columns."""
    r2 = "pow(try_divide(flux, flux_err), 2D)"
    per = aggregate_with_medians(lc, ["object_id", "passband"], [
        F.expr(f"try_divide(sum(flux * {r2}), sum({r2})) AS _m"), F.stddev_samp("flux").alias("_std")], {"_med": ("flux", None)})
    rows = join_back(lc, per, ["object_id", "passband"])
    medians = {}
    aggs = []
    for b, name in zip(BANDS, BAND_LETTERS):
        def on(x, b=b):
            return f"CASE WHEN passband = {b} THEN {x} END"
        aggs += [F.expr(e) for e in (
            f"max({on('_m')}) AS {name}Mean",
            f"stddev_samp({on('try_divide(flux, flux_err)')}) AS {name}Std",
            f"try_divide(max({on('flux')}) - min({on('flux')}), max({on('_m')})) AS {name}Amp",
            f"avg({on('CASE WHEN abs(flux - _m) > _std THEN 1D ELSE 0D END')}) AS {name}Beyond",
            f"CASE WHEN count({on('flux')}) >= 3 THEN skewness({on('flux')}) END AS {name}Skew",
        )]
        medians[f"{name}MAD"] = ("abs(try_divide(flux - _med, _m))", f"passband = {b}")
    agg = aggregate_with_medians(rows, ["object_id"], aggs, medians,
                                 [f"{n}{x}" for n in BAND_LETTERS for x in ("Mean", "Std", "Amp", "MAD", "Beyond", "Skew")])
    colours = {}
    for a, b in zip(BAND_LETTERS[:-1], BAND_LETTERS[1:]):
        ma, mb = F.col(f"{a}Mean"), F.col(f"{b}Mean")
        colours[f"{a}Minus{b.upper()}"] = F.when((ma > 0) & (mb > 0), F.lit(-2.5) * F.log10(ma / mb)) \
            .otherwise(F.lit(-999.0))
    out = agg.withColumns(colours).drop(*[f"{n}Mean" for n in BAND_LETTERS])
    return restore_objects(out, ids)


def band_flux_moments(lc: DataFrame, meta: DataFrame) -> DataFrame:
    """Mean and sample std per band of the pure magnitude minus distmod (NULL distmod -> 0), extragalactic objects.
    ``lc``: the splits stacked (``prep.stack_splits``)."""
    dm = meta.filter(F.col("hostgal_photoz") != 0).select("object_id", F.coalesce("distmod", F.lit(0.0)).alias("_dm"))
    rows = lc.join(dm, "object_id").withColumn("flux", pure_magnitude("flux", "_dm"))
    return rows.groupBy("passband").agg(F.avg("flux").alias("flux_mean"), F.stddev_samp("flux").alias("flux_std"),
                                        F.count(F.lit(1)).alias("n"))


def quantiles_by_class(df: DataFrame, col: str, label: str = "target") -> DataFrame:
    """Box-plot data of ``col`` per class (min, quartiles, max; linear interpolation)."""
    n = df.groupBy(label).agg(F.count(F.col(col)).alias("n"))
    q = exact_quantiles(df, [label], col, [0.0, 0.25, 0.5, 0.75, 1.0])
    return join_back(n, q, [label]).select(label, "n", *[F.col(f"_q{i}").alias(x) for i, x in enumerate(("q0", "q25", "q50", "q75", "q100"))])


def correlations(df: DataFrame, target: str, cols: list[str]) -> DataFrame:
    """Pearson correlation of ``target`` with each column (one pass)."""
    return df.agg(*[F.corr(target, c).alias(f"corr_{c}") for c in cols if c != target])


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """(a, b, r) for every pair of columns, both orders and the diagonal (one pass)."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    one = df.agg(F.array(*[F.corr(a, b) for a, b in pairs]).alias("r"))
    rows = [F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col("r")[i].alias("r")) for i, (a, b) in enumerate(pairs) for x, y in ((a, b), (b, a))]
    rows += [F.struct(F.lit(c).alias("a"), F.lit(c).alias("b"), F.lit(1.0).alias("r")) for c in cols]
    return one.select(F.inline(F.array(*rows)))


def class_boxes(meta: DataFrame, group: str = "target") -> DataFrame:
    """Bounding boxes (gal_l, gal_b) of ddf objects per group -- one row per group."""
    return (meta.filter(F.col("ddf") == 1).groupBy(group)
            .agg(F.min("gal_l").alias("min_gal_l"), F.max("gal_l").alias("max_gal_l"),
                 F.min("gal_b").alias("min_gal_b"), F.max("gal_b").alias("max_gal_b")))


CELL_DEGREES = 10.0


def box_coverage(meta: DataFrame, boxes: DataFrame, box_key: str) -> DataFrame:
    """Point-in-box range join; number of objects per (box, ddf).

    Boxes are cut into longitude cells of ``CELL_DEGREES``; an object lies in one cell, so the range join is an
    equi-join on the cell plus the exact test, whatever the number of boxes."""
    cell = lambda c: F.floor(F.col(c) / CELL_DEGREES)
    b = boxes.select(F.col(box_key).alias("_box"), "min_gal_l", "max_gal_l", "min_gal_b", "max_gal_b",
                     F.explode(F.sequence(cell("min_gal_l"), cell("max_gal_l"))).alias("_cell"))
    m = meta.select("ddf", "gal_l", "gal_b", cell("gal_l").alias("_cell"))
    inside = F.col("gal_l").between(F.col("min_gal_l"), F.col("max_gal_l")) & F.col("gal_b").between(F.col("min_gal_b"), F.col("max_gal_b"))
    return m.join(b, "_cell").filter(inside).groupBy(F.col("_box").alias(box_key), "ddf").agg(F.count(F.lit(1)).alias("n"))


def region_boxes(meta: DataFrame, k: int = 5, seed: int = 0) -> DataFrame:
    """K-means (k=5) on (gal_l, gal_b) of ddf objects, box per cluster,
    and the point-in-box coverage of all objects."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    ddf = meta.filter(F.col("ddf") == 1)
    vec = VectorAssembler(inputCols=["gal_l", "gal_b"], outputCol="features").transform(ddf)
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(vec)
    clustered = model.transform(vec).select("object_id", "gal_l", "gal_b", "cluster", "ddf")
    boxes = class_boxes(clustered, "cluster")
    return box_coverage(meta, boxes, "cluster")
