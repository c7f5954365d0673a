"""Peak-centred row subsets (G15, G16) and the feature sets on them.

Peaks, segments and anchors are mergeable aggregates joined back on their key; series steps come from
``functions.windows``.  No step needs all rows of an object in one task.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import pure_magnitude, snap
from ..functions.windows import join_back, keeps_whole, key_values, lag_columns, running_sums
from . import scaling, stats


def segment_by_gap(lc: DataFrame, gap: float = 100.0, keep: str = "peak") -> DataFrame:
    """Split each object's series (all bands, by time) where the time
    step is strictly greater than ``gap``; keep the rows of the segment with
    the largest flux (earliest segment on ties; a segment without flux counts 0).

    ``keep="all"`` returns every row with its ``segment`` number instead.
    """
    if keeps_whole(lc, ["object_id"]):
        return _segments_of_whole(lc, gap, keep)
    steps = lag_columns(lc.select("object_id", "mjd", "passband"), ["object_id"], "mjd", ["mjd"], "_prev_", ties=("passband",))
    # a break needs more than ``gap`` days, so an object has fewer breaks than its time span has gaps
    breaks = steps.filter(F.col("mjd") - F.col("_prev_mjd") > gap).groupBy("object_id").agg(
        F.sort_array(F.collect_list("mjd")).alias("_breaks"))
    number = F.coalesce(F.size(F.filter("_breaks", lambda t: t <= F.col("mjd"))), F.lit(0)).cast("int")
    seg = join_back(lc, breaks, ["object_id"]).withColumn("segment", number).drop("_breaks")
    if keep == "all":
        return seg
    peaks = seg.groupBy("object_id", "segment").agg(F.coalesce(F.max("flux"), F.lit(0.0)).alias("_max"))
    best = peaks.groupBy("object_id").agg(F.max_by("segment", F.struct("_max", -F.col("segment"))).alias("_best"))
    return join_back(seg, best, ["object_id"]).filter(F.col("segment") == F.col("_best")).drop("_best", "segment")


def _segments_of_whole(lc: DataFrame, gap: float, keep: str) -> DataFrame:
    """``segment_by_gap`` for small objects only: windows over the object, which share one exchange and sort."""
    by, time = Window.partitionBy("object_id"), Window.partitionBy("object_id").orderBy("mjd", "passband")
    seg = lc.withColumn("_new", (F.col("mjd") - F.lag("mjd").over(time) > gap).cast("int"))
    seg = seg.withColumn("segment", F.coalesce(F.sum("_new").over(time.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0)).cast("int"))
    seg = seg.drop("_new")
    if keep == "all":
        return seg
    # a segment's largest flux, the earliest segment on ties: a segment without flux counts 0
    seg = seg.withColumn("_max", F.coalesce(F.max("flux").over(Window.partitionBy("object_id", "segment")), F.lit(0.0)))
    best = F.max_by("segment", F.struct("_max", -F.col("segment"))).over(by)
    return seg.withColumn("_best", best).filter(F.col("segment") == F.col("_best")).drop("_best", "_max", "segment")


def peak_mjd_expr() -> F.Column:
    """mjd of the maximum flux of an object (earliest mjd on ties)."""
    return F.max_by("mjd", F.struct(F.col("flux"), -F.col("mjd")))


def window_around_peak(lc: DataFrame, half_width: float = 100.0) -> DataFrame:
    """Rows with peak - w <= mjd < peak + w (lower bound in, upper bound out)."""
    with_peak = key_values(lc, ["object_id"], {"_peak": peak_mjd_expr()})
    return (with_peak
            .filter((F.col("mjd") >= F.col("_peak") - half_width) & (F.col("mjd") < F.col("_peak") + half_width))
            .drop("_peak"))


def maxpoint(lc: DataFrame, meta: DataFrame | None = None, mode: str = "gap", width: float = 100.0) -> DataFrame:
    """Object stats without ``detected`` on the peak rows (40 columns)."""
    rows = segment_by_gap(lc, width) if mode == "gap" else window_around_peak(lc, width)
    return stats.object_stats(rows, meta, detected=False, detected_variant=True, drop=())


def maxpoint_passband(lc: DataFrame, meta: DataFrame | None = None, gap: float = 100.0) -> DataFrame:
    """G18 (v1): band stats + ratios on the gap segment of the peak (54 columns)."""
    return stats.band_features(segment_by_gap(lc, gap), meta, contrasts=False, drop_stats=())


def maxpoint_passband_v2(lc: DataFrame, meta: DataFrame, half_width: float = 100.0,
                         fill_distmod: float | None = None) -> DataFrame:
    """Detected rows of the peak window, flux as pure magnitude minus
    distmod (galactic distmod stays NULL unless ``fill_distmod``), then band
    stats, ratios and contrasts (89 columns)."""
    dm = F.col("distmod") if fill_distmod is None else F.coalesce(F.col("distmod"), F.lit(fill_distmod))
    rows = (window_around_peak(lc, half_width).filter(F.col("detected") == 1)
            .join(meta.select("object_id", dm.alias("_dm")), "object_id", "inner"))
    rows = rows.withColumn("flux", pure_magnitude("flux", "_dm")).drop("_dm")
    return stats.band_features(rows, meta, contrasts=True, drop_stats=())


def fluxfactor_maxpoint(lc: DataFrame, meta: DataFrame, gap: float = 100.0) -> DataFrame:
    """G20 (object form): photoz^2 scaling on the peak segment, then G17."""
    rows = scaling.scale_by_photoz2(segment_by_gap(lc, gap), meta)
    return stats.object_stats(rows, meta, detected=False, detected_variant=True, drop=())


def fluxfactor_maxpoint_passband(lc: DataFrame, meta: DataFrame, gap: float = 100.0) -> DataFrame:
    """G20 (band form): photoz^2 scaling on the peak segment, then G6 + G7."""
    rows = scaling.scale_by_photoz2(segment_by_gap(lc, gap), meta)
    return stats.band_features(rows, meta, contrasts=False, drop_stats=())


def split_steps(lc: DataFrame) -> DataFrame:
    """Exact two-means of each object's time steps: object_id, split_step (the largest short step), n_short, n_long,
    mean_short, mean_long.  Steps are cut where the squares within both groups are least (the smaller step on ties);
    objects with fewer than two different steps have no row.

    Equal steps collapse to counts; running counts and sums over the steps by length, slice by slice, give every cut's gain."""
    steps = _steps(lc).filter("step IS NOT NULL").groupBy("object_id", "step").agg(F.count(F.lit(1)).alias("c")).withColumn("_tie", F.lit(0))
    run = running_sums(steps, ["object_id"], "step", "_tie", {"n1": "c", "s1": "c * step"})
    total = steps.groupBy("object_id").agg(F.sum("c").alias("n"), F.expr("sum(c * step) AS s"), F.max("step").alias("top"))
    cuts = join_back(run, total, ["object_id"]).filter("step < top")
    gain = cuts.withColumn("gain", F.expr("s1 * s1 / n1 + (s - s1) * (s - s1) / (n - n1) - s * s / n"))
    best = gain.groupBy("object_id").agg(F.max_by(F.struct("step", "n1", "s1", "n", "s"), F.struct(snap("gain"), -F.col("step"))).alias("b"))
    return best.selectExpr("object_id", "b.step AS split_step", "CAST(b.n1 AS BIGINT) AS n_short", "CAST(b.n - b.n1 AS BIGINT) AS n_long",
                           "b.s1 / b.n1 AS mean_short", "(b.s - b.s1) / (b.n - b.n1) AS mean_long")


def _steps(lc: DataFrame) -> DataFrame:
    rows = lc.filter("mjd IS NOT NULL").withColumn("_tie", F.struct("passband", "flux", "flux_err"))
    return lag_columns(rows, ["object_id"], "mjd", ["mjd"], "_p_", ties=("_tie",)).withColumn("step", F.expr("mjd - _p_mjd"))


def segment_two_means(lc: DataFrame) -> DataFrame:
    """W5, two-means form: rows with ``segment``, which grows by one at every step of the object's long group (rows without a
    time are no part of a series)."""
    rows = join_back(_steps(lc), split_steps(lc).select("object_id", "split_step"), ["object_id"])
    rows = running_sums(rows.drop("_p_mjd"), ["object_id"], "mjd", "_tie", {"segment": "CASE WHEN step > split_step THEN 1D END"})
    return rows.withColumn("segment", F.col("segment").cast("int")).drop("_tie", "step", "split_step")
