"""C11: fit of a damped random walk to every series, by associative scans over slices.

Model: flux less its weighted mean is an exponentially correlated process of the series' population variance V and
relaxation time tau, plus the errors.  The Kalman recursion over the points in time gives innovations v with variance F;
chi2 = sum v^2 / F.  It is sequential, but each step is a map of what stands before it, and maps compose:

* the filtered variance goes through P -> e^2 (a^2 P + q) / (a^2 P + q + e^2), a fraction of two lines, so a slice of
  points is one 2 x 2 matrix; a fold over the series' slices gives the variance at the start of each;
* with that known, the state goes through an affine map and chi2 is a square polynomial of the state at the start, so a
  second fold per slice gives five numbers, and a fold over those the series' chi2.

A task holds one slice of one series at a time.  Points without time or flux, or with error zero, are no part of the
series; points of one time follow each other without relaxation, in order of flux and error.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.slices import cut_points, slice_rows, slice_sql
from ..functions.windows import join_back, key_values, lag_columns

SERIES = ["object_id", "passband"]
TAU = 100.0  # days
SLICE = 250_000  # points of a slice, which a task folds as one array


def walk_fit(lc: DataFrame, tau: float = TAU) -> DataFrame:
    """Per (object, band) of at least two points and some variance: qso_log_chi2_qsonu = ln(chi2 / (n - 1)) and
    qso_log_chi2nuNULL_chi2nu = ln(chi2 of the constant weighted mean / chi2)."""
    rows = lc.select(*SERIES, "mjd", "flux", "flux_err").filter("mjd IS NOT NULL AND flux IS NOT NULL AND flux_err != 0")
    rows = key_values(rows, SERIES, {"_wx": F.expr("sum(flux / pow(flux_err, 2))"), "_w": F.expr("sum(1 / pow(flux_err, 2))"), "V": F.var_pop("flux")})
    rows = rows.filter("V > 0").withColumn("_m", F.expr("_wx / _w")).drop("_wx", "_w")
    limit = min(SLICE, slice_rows(lc))
    rows = lag_columns(rows, SERIES, "mjd", ["mjd"], "_p_", ties=("flux", "flux_err"))
    cuts = cut_points(rows, "mjd", limit, SERIES)   # small series are one slice each
    rows = rows.withColumns({"_s": F.expr(slice_sql("mjd", cuts)), "x": F.expr("flux - _m"), "e": F.expr("pow(flux_err, 2)"),
                             "a": F.expr(f"coalesce(exp((_p_mjd - mjd) / {tau!r}D), 0D)")})   # nothing carries into the first point
    parts = rows.groupBy(*SERIES, "_s").agg(F.first("V").alias("V"), F.expr("sum(x * x / e) AS flat"), F.count(F.lit(1)).alias("n"),
                                            F.expr("sort_array(collect_list(struct(mjd, flux, flux_err, x, e, a))) AS pts"))
    if not cuts:
        parts = parts.withColumn("P0", F.col("V"))
    else:
        ident = "struct(1D AS p, 0D AS q, 0D AS r, 1D AS s)"
        turn = "struct(k.e * k.a * k.a AS p, k.e * V * (1 - k.a * k.a) AS q, k.a * k.a AS r, V * (1 - k.a * k.a) + k.e AS s)"
        then = "struct(m.p * acc.p + m.q * acc.r AS p, m.p * acc.q + m.q * acc.s AS q, m.r * acc.p + m.s * acc.r AS r, m.r * acc.q + m.s * acc.s AS s)"
        # a fraction's matrix may be scaled: the last entry is kept at 1, so that long products neither vanish nor overflow
        scale = (f"transform(transform(array({turn}), m -> {then}), m -> struct(m.p / m.s AS p, m.q / m.s AS q, m.r / m.s AS r, 1D AS s))[0]")
        maps = parts.select(*SERIES, "_s", "V", F.expr(f"aggregate(pts, {ident}, (acc, k) -> {scale}) AS m"))
        series = maps.groupBy(*SERIES).agg(F.first("V").alias("V"), F.expr("sort_array(collect_list(struct(_s, m))) AS ms"))
        starts = series.withColumn("at", F.expr("aggregate(ms, array(V), (acc, k) -> concat(acc, array((k.m.p * element_at(acc, -1) + k.m.q) / "
                                                "(k.m.r * element_at(acc, -1) + k.m.s))))"))
        starts = starts.select(*SERIES, F.expr("inline(zip_with(ms, slice(at, 1, size(ms)), (k, v) -> struct(k._s AS _s, v AS P0)))"))
        parts = join_back(parts, starts, [*SERIES, "_s"])
    # al + be * s: state for the state s at the start; chi2 = c0 - 2 c1 s + c2 s^2
    move = ("transform(transform(transform(array(k), k -> struct(k.x - k.a * acc.al AS u, k.a * acc.be AS w, k.a AS a, k.e AS e, "
            "k.a * k.a * acc.p + V * (1 - k.a * k.a) AS pm)), k -> struct(k.u, k.w, k.a, k.e, k.pm, k.pm + k.e AS f)), "
            "k -> struct(k.pm * k.e / k.f AS p, k.a * acc.al + k.pm / k.f * k.u AS al, k.w - k.pm / k.f * k.w AS be, "
            "acc.c0 + k.u * k.u / k.f AS c0, acc.c1 + k.u * k.w / k.f AS c1, acc.c2 + k.w * k.w / k.f AS c2))[0]")
    parts = parts.select(*SERIES, "_s", "n", "flat", F.expr(
        f"aggregate(pts, struct(P0 AS p, 0D AS al, 1D AS be, 0D AS c0, 0D AS c1, 0D AS c2), (acc, k) -> {move}) AS g"))
    done = parts.groupBy(*SERIES).agg(F.sum("n").alias("n"), F.sum("flat").alias("flat"), F.expr(
        "aggregate(sort_array(collect_list(struct(_s, g))), struct(0D AS s, 0D AS chi2), (acc, k) -> struct(k.g.al + k.g.be * acc.s AS s, "
        "acc.chi2 + k.g.c0 - 2 * k.g.c1 * acc.s + k.g.c2 * acc.s * acc.s AS chi2)).chi2 AS chi2"))
    return done.filter("n > 1").selectExpr(*SERIES, "ln(chi2 / (n - 1)) AS qso_log_chi2_qsonu", "ln(flat / chi2) AS qso_log_chi2nuNULL_chi2nu")
