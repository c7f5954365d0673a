"""Time-bucket band pivots and band-pair differences.

Plan: hash-partition the observations once on ``object_id``; the bucket
``groupBy(object_id, bucket)``, the long per-(object, pair) aggregate and the
final pivot to wide columns all reuse that partitioning, so the 480-column
feature set costs one shuffle.  Aggregation is done in long form (15 pairs as
rows) and pivoted last, which keeps generated code small.
"""
from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggspec import compile_aggs, split_spec
from ..functions.core import BANDS, safe_div
from ..functions.quantiles import aggregate_with_medians
from ..functions.windows import keeps_whole
from .stats import restore_objects

# (base, target) band pairs, base < target, in itertools order.
BAND_PAIRS = list(itertools.combinations(BANDS, 2))
PAIR_NAMES = [f"{t}_{b}" for b, t in BAND_PAIRS]
BUCKET_AGGS = ["min", "max", "mean", "median", "std", "skew", "sum"]
PAIR_COLS = ["flux", "flux_err", "flux_ratio_sq", "flux_by_flux_ratio_sq"]


def bucket_index(width_days: float, origin: float = 0.0) -> F.Column:
    """Bucket number of ``mjd`` for buckets of ``width_days`` starting at ``origin`` (MJD)."""
    return F.floor((F.col("mjd") - F.lit(origin)) / F.lit(width_days)).cast("long")


def bucket_pivot(lc: DataFrame, width_days: float = 14.0, origin: float = 0.0) -> DataFrame:
    """One row per (object, bucket) with mean flux / flux_err per band as columns."""
    aggs = []
    for b in BANDS:
        aggs.append(F.expr(f"avg(CASE WHEN passband = {b} THEN flux END) AS flux_{b}"))
        aggs.append(F.expr(f"avg(CASE WHEN passband = {b} THEN flux_err END) AS flux_err_{b}"))
    return lc.groupBy("object_id", bucket_index(width_days, origin).alias("bucket")).agg(*aggs)


def bucket_band_diff_long(pivot: DataFrame) -> DataFrame:
    """G27 in long form: one row per (object, bucket, pair) with flux difference,
    quadrature error, ratio_sq and flux*ratio_sq."""
    structs = ", ".join(
        f"named_struct('pair', '{name}', 'flux', flux_{t} - flux_{b}, "
        f"'flux_err', sqrt(pow(flux_err_{t}, 2) + pow(flux_err_{b}, 2)))"
        for (b, t), name in zip(BAND_PAIRS, PAIR_NAMES))
    long = pivot.selectExpr("object_id", "bucket", f"inline(array({structs}))")
    r2 = F.pow(safe_div("flux", "flux_err"), 2.0)
    return long.withColumns({"flux_ratio_sq": r2, "flux_by_flux_ratio_sq": F.col("flux") * r2})


def bucket_band_diff(pivot: DataFrame) -> DataFrame:
    """G27 in wide form: 60 columns per (object, bucket), ``flux_<t>_<b>`` etc."""
    cols = {}
    for b, t in BAND_PAIRS:
        diff = F.col(f"flux_{t}") - F.col(f"flux_{b}")
        err = F.sqrt(F.pow(F.col(f"flux_err_{t}"), 2) + F.pow(F.col(f"flux_err_{b}"), 2))
        r2 = F.pow(safe_div(diff, err), 2.0)
        cols[f"flux_{t}_{b}"] = diff
        cols[f"flux_err_{t}_{b}"] = err
        cols[f"flux_ratio_sq_{t}_{b}"] = r2
        cols[f"flux_by_flux_ratio_sq_{t}_{b}"] = diff * r2
    return pivot.select("object_id", "bucket", *[c.alias(n) for n, c in cols.items()])


def timegrouper(lc: DataFrame, ids: DataFrame | None = None, width_days: float = 14.0,
                origin: float = 0.0) -> DataFrame:
    """Per object, {min,max,mean,median,std,skew,sum} of the 60 bucket
    pair columns plus diff, dif2, w_mean, dif3 per pair (480 columns)."""
    pivot = bucket_pivot(lc, width_days, origin)
    # a pair with no value in a bucket adds to no aggregate; a pair without any is NULL below, as one of NULLs would be
    long = bucket_band_diff_long(pivot).filter("flux IS NOT NULL OR flux_err IS NOT NULL")
    # cells, not observations: an object has at most its time span / width of them
    spec = {c: BUCKET_AGGS for c in PAIR_COLS}
    if keeps_whole(long, ["object_id"]):
        per_pair = aggregate_with_medians(long, ["object_id", "pair"], *split_spec(spec))
    else:
        per_pair = long.groupBy("object_id", "pair").agg(*compile_aggs(spec))
    mx, mn, mean = F.col("flux_max"), F.col("flux_min"), F.col("flux_mean")
    w_mean = safe_div("flux_by_flux_ratio_sq_sum", "flux_ratio_sq_sum")
    per_pair = per_pair.withColumns({"diff": mx - mn, "dif2": safe_div(mx - mn, mean), "w_mean": w_mean,
                                     "dif3": safe_div(mx - mn, w_mean)})
    value_cols = [f"{c}_{a}" for c in PAIR_COLS for a in BUCKET_AGGS] + ["diff", "dif2", "w_mean", "dif3"]
    # pivot last: 15 aggregates of a struct (at most 15 rows an object) instead of 480 conditional ones
    struct = f"struct({', '.join(value_cols)})"
    packed = per_pair.groupBy("object_id").agg(*[F.expr(f"first(CASE WHEN pair = '{p}' THEN {struct} END, true) AS _{p}") for p in PAIR_NAMES])
    outs = ["object_id"]
    for p in PAIR_NAMES:
        for c in PAIR_COLS:
            for a in BUCKET_AGGS:
                outs.append(f"_{p}.{c}_{a} AS {c}_{p}_{a}")
        for d in ("diff", "dif2", "w_mean", "dif3"):
            outs.append(f"_{p}.{d} AS flux_{d}_{p}")
    wide = packed.selectExpr(*outs)
    # objects without any value have no pair left
    return restore_objects(wide, lc.select("object_id").distinct() if ids is None else ids)


def bucket_coverage(lc: DataFrame, widths=(0.25, 1, 3, 5, 7, 14, 30, 60, 90, 120), origin: float = 0.0) -> DataFrame:
    """For each bucket width (days): number of (object, bucket) cells and the
    share of cells where every band has a value.  One pass: the widths are an
    exploded literal column, not a join."""
    ws = lc.select("object_id", "mjd", "passband",
                   F.explode(F.array(*[F.lit(float(w)) for w in widths])).alias("width_days"))
    cells = (ws.groupBy("width_days", "object_id",
                        F.floor((F.col("mjd") - F.lit(origin)) / F.col("width_days")).cast("long").alias("bucket"))
             .agg(F.bit_or(F.expr("shiftleft(1, passband)")).alias("band_mask")))
    full = (1 << len(BANDS)) - 1
    return cells.groupBy("width_days").agg(
        F.count(F.lit(1)).alias("n_buckets"),
        F.avg(F.when(F.col("band_mask") == full, 1.0).otherwise(0.0)).alias("complete_share"))
