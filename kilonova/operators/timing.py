"""Time-of-feature operators (G30, G31, G33, G34; windows W6, W7).

Per-object thresholds (quantiles, amplitude fractions, peak levels) are mergeable aggregates (or exact quantiles from
value slices) joined back on their key; the per-object results are conditional aggregates in one ``groupBy``.
"""
from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import BANDS
from ..functions.quantiles import quantiles_by_key
from ..functions.windows import join_back
from .stats import restore_objects

# Fixed parameter lists of the reference feature sets.
QUANTILES = [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95]
AMPLITUDE_FRACTIONS = [0.05, 0.1, 0.2, 0.3, 0.4]
PEAK_LEVELS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]


def _num(x: float) -> str:
    """0.05 -> '0_05' (column-name safe)."""
    return str(x).replace(".", "_").replace("-", "_")


def time_above_quantile(lc: DataFrame, ids: DataFrame | None = None, q_list=QUANTILES) -> DataFrame:
    """Per object, max(mjd) - min(mjd) of rows with flux above its q-quantile
    (linear interpolation); one column ``mjd_diff_<q>`` per q."""
    th = quantiles_by_key(lc, "object_id", "flux", list(q_list))
    th = th.select("object_id", F.array(*[F.col(f"_q{i}") for i in range(len(q_list))]).alias("_q"))
    rows = join_back(lc, th, ["object_id"])
    aggs = [F.expr(f"max(CASE WHEN flux > _q[{i}] THEN mjd END) - min(CASE WHEN flux > _q[{i}] THEN mjd END) "
                   f"AS mjd_diff_{_num(q)}") for i, q in enumerate(q_list)]
    return restore_objects(rows.groupBy("object_id").agg(*aggs), ids)


def time_above_amplitude(lc: DataFrame, ids: DataFrame | None = None, fractions=AMPLITUDE_FRACTIONS) -> DataFrame:
    """Span of rows with flux > frac * (max - min) of the object."""
    rows = join_back(lc, lc.groupBy("object_id").agg((F.max("flux") - F.min("flux")).alias("_amp")), ["object_id"])
    aggs = [F.expr(f"max(CASE WHEN flux > _amp * {f!r} THEN mjd END) - min(CASE WHEN flux > _amp * {f!r} THEN mjd END) "
                   f"AS mjd_diff_amp_{_num(f)}") for f in fractions]
    return restore_objects(rows.groupBy("object_id").agg(*aggs), ids)


def time_from_peak(lc: DataFrame, ids: DataFrame | None = None, levels=PEAK_LEVELS) -> DataFrame:
    """Per (object, band) on detected rows, with the peak at the max flux
    (earliest on ties) and level thr = min + (max - min) * p: time from the peak
    to the first later point with flux < thr (``after``) and from the last
    earlier such point to the peak (``before``).  108 columns."""
    det = lc.filter(F.col("detected") == 1)
    anchors = {
        "_peak": F.max_by("mjd", F.struct(F.col("flux"), -F.col("mjd"))),
        "_fmax": F.max("flux"),
        "_fmin": F.min("flux"),
    }
    per = det.groupBy("object_id", "passband").agg(*[e.alias(n) for n, e in anchors.items()])
    rows = join_back(det, per, ["object_id", "passband"])
    aggs, out = [], ["object_id"]
    for b in BANDS:
        aggs.append(F.expr(f"max(CASE WHEN passband = {b} THEN _peak END) AS _peak_{b}"))
        for which in ("after", "before"):
            for p in levels:
                low = f"passband = {b} AND flux < _fmin + (_fmax - _fmin) * {p!r}"
                n = f"_{which}_{_num(p)}_{b}"
                name = f"time_from_peak_{which}_thres{_num(p)}_pass{b}"
                if which == "after":
                    aggs.append(F.expr(f"min(CASE WHEN {low} AND mjd > _peak THEN mjd END) AS {n}"))
                    out.append(f"{n} - _peak_{b} AS {name}")
                else:
                    aggs.append(F.expr(f"max(CASE WHEN {low} AND mjd < _peak THEN mjd END) AS {n}"))
                    out.append(f"_peak_{b} - {n} AS {name}")
    agg = rows.groupBy("object_id").agg(*aggs)
    return restore_objects(agg.selectExpr(*out), ids)


def diff_peak(lc: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Per object, mjd of the max flux per band on detected rows (earliest on
    ties) and its difference for the 15 band pairs ``peakpoint_pass<a>_pass<b>``."""
    det = lc.filter(F.col("detected") == 1)
    aggs = [F.max_by(F.when(F.col("passband") == b, F.col("mjd")),
                     F.when(F.col("passband") == b, F.struct(F.col("flux"), -F.col("mjd")))).alias(f"pass{b}")
            for b in BANDS]
    agg = det.groupBy("object_id").agg(*aggs)
    pairs = {f"peakpoint_pass{a}_pass{b}": F.col(f"pass{a}") - F.col(f"pass{b}")
             for a, b in itertools.combinations(BANDS, 2)}
    return restore_objects(agg.select("object_id", *[c.alias(n) for n, c in pairs.items()]), ids)
