"""One object with most of the rows: every operator gives the same with one slice and with many."""
import random

import pytest
from pyspark.sql import functions as F

from kilonova.functions.core import round_all
from kilonova.functions.windows import join_back, lag_columns
from kilonova.operators import peaks, rates, research, series, stats, timing

LC = "object_id long, mjd double, passband int, flux double, flux_err double, detected int"
KEYS = ["object_id", "passband"]


@pytest.fixture(scope="module")
def lc(spark):
    rnd = random.Random(4)
    t = [rnd.uniform(0, 40) for _ in range(1500)] + [500 + rnd.uniform(0, 900) for _ in range(300)]  # a burst, then a gap
    rows = [(1, x, i % 2, float(rnd.randint(-3, 3)), rnd.uniform(0.5, 2), rnd.randint(0, 1)) for i, x in enumerate(t)]
    rows += [(k, rnd.uniform(0, 800), rnd.randint(0, 5), rnd.gauss(0, 3), 1.0, 1) for k in range(2, 9) for _ in range(20)]
    rows += [(1, None, 0, 9.0, 1.0, 1), (1, 700.5, 1, None, 1.0, 1), (9, 5.0, 2, 1.0, 0.0, 1)]
    return spark.createDataFrame(rows, LC)


def sliced(spark, make, rows=60):
    norm = lambda df: sorted((tuple(r) for r in round_all(df).collect()), key=repr)
    plain = norm(make())
    spark.conf.set("kilonova.sliceRows", str(rows))
    try:
        assert norm(make()) == plain
    finally:
        spark.conf.unset("kilonova.sliceRows")
    return plain


def test_lag(spark, lc):
    got = sliced(spark, lambda: lag_columns(lc, KEYS, "mjd", ["mjd", "flux"], ties=("flux", "flux_err")))
    by = {}
    for r in got:
        by.setdefault((r[0], r[2]), []).append(r)
    for rs in by.values():
        known = sorted((r for r in rs if r[1] is not None), key=lambda r: r[1])
        assert known[0][-2] is None and all(b[-2] == a[1] for a, b in zip(known, known[1:]))
        assert all(r[-2] is None and r[-1] is None for r in rs if r[1] is None)


@pytest.mark.parametrize("make", [
    stats.basic_ts, stats.object_stats, rates.fluxdiff, rates.fluxdiff_passband, rates.fluxdiffdiff, peaks.segment_by_gap,
    peaks.window_around_peak, peaks.maxpoint, peaks.maxpoint_passband, timing.time_above_quantile, timing.time_above_amplitude,
    timing.time_from_peak, research.time_steps, research.lightcurve_summary, series.series_general, series.series_cadence,
], ids=lambda f: f.__name__)
def test_operators(spark, lc, make):
    assert sliced(spark, lambda: make(lc.dropna(subset=["mjd"])))


@pytest.mark.parametrize("name", ["basic_ts", "fluxdiff_passband", "maxpoint_gap", "time_above_quantile", "series_cadence", "quantiles_by_class"])
def test_queries_in_slices_equal_duckdb(spark, name):
    from tests.test_oracle import equal_to_oracle

    spark.conf.set("kilonova.sliceRows", "200")
    try:
        equal_to_oracle(spark, name)
    finally:
        spark.conf.unset("kilonova.sliceRows")


def test_join_back_keeps_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (1, 2), (1, 3)], "k long, v int")
    per = df.groupBy("k").agg({"v": "max"}).withColumnRenamed("max(v)", "m")
    assert sorted(join_back(df, per, ["k"]).collect(), key=str) == sorted([(1, 2, 3), (1, 3, 3), (None, 1, 1)], key=str)


def test_walk_equals_the_recursion(spark, lc):
    from math import exp, log

    from kilonova.operators.walk import TAU, walk_fit

    got = {r[:2]: r[2:] for r in sliced(spark, lambda: walk_fit(lc), rows=40)}
    series_ = {}
    for r in lc.collect():
        if r.mjd is not None and r.flux is not None and r.flux_err != 0:
            series_.setdefault((r.object_id, r.passband), []).append((r.mjd, r.flux, r.flux_err))
    want = {}
    for k, pts in series_.items():
        pts.sort()
        n, mean = len(pts), sum(x / e ** 2 for _, x, e in pts) / sum(1 / e ** 2 for _, _, e in pts)
        plain = sum(x for _, x, _ in pts) / n
        v = sum((x - plain) ** 2 for _, x, _ in pts) / n
        if n < 2 or v == 0:
            continue
        p, s, chi, flat, last = v, 0.0, 0.0, 0.0, None
        for t, x, e in pts:
            a = 0.0 if last is None else exp((last - t) / TAU)
            last = t
            pm, s = a * a * p + v * (1 - a * a), a * s
            f, u = pm + e * e, x - mean - s
            chi, flat = chi + u * u / f, flat + (x - mean) ** 2 / e ** 2
            s, p = s + pm / f * u, pm * e * e / f
        want[k] = (log(chi / (n - 1)), log(flat / chi))
    assert set(got) == set(want) and max(map(abs, want[1, 0])) > 0
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=2e-6, abs=1e-9)


def test_lag_correlations_in_slices(spark, lc):
    from kilonova.operators import spectral

    two = lc.filter("object_id = 1").unionByName(lc.filter("passband IN (0, 1)").filter("object_id > 1"))
    sliced(spark, lambda: spectral.interpolated_pairs(two, 0, 1, [-5.0, 0.0, 2.5, 700.0]), rows=300)
    sliced(spark, lambda: spectral.cross_correlation(two, None, 0, 1, -4.0, 4.0, 2.0, replicates=16), rows=300)
    for weighting in ("slot", "gauss"):
        sliced(spark, lambda: spectral.discrete_correlation(two, None, 0, 1, -4.0, 4.0, 2.0, weighting), rows=300)


def test_bootstrap_weights_are_poisson(spark):
    from kilonova.operators.spectral import bootstrap_weights

    rows = spark.range(300).selectExpr(f"posexplode({bootstrap_weights('id', 100)}) AS (rep, k)").groupBy("k").count().collect()
    share = {r["k"]: r["count"] / 30000 for r in rows}
    assert sum(share.values()) == pytest.approx(1)
    for k, p in ((0, 0.3679), (1, 0.3679), (2, 0.1839), (3, 0.0613)):
        assert share[k] == pytest.approx(p, abs=0.012)


def test_resampling_by_points(spark, lc):
    """No row per pair and replicate; the weights are the SQL's, and an object dealt over parts gives the same."""
    from kilonova.operators import spectral

    ids = spark.createDataFrame([(f"{i}:5",) for i in range(50)], "p string").selectExpr("p", f"{spectral.bootstrap_weights('p', 100)} AS w").collect()
    assert spectral.point_weights([r.p for r in ids], 100).tolist() == [r.w for r in ids]
    lags = [-4.0, 0.0, 4.0]
    point = "concat(object_id, ':', CAST(round(mjd * 86400000) AS BIGINT))"
    pairs = spectral.interpolated_pairs(lc.withColumn("point", F.expr(point)), 0, 1, lags, ("point",)).checkpoint()
    got = [sorted(map(tuple, round_all(spectral._resampled(pairs, lags, 0.8, 16, n)).collect())) for n in (10 ** 6, 100)]
    assert got[0] == got[1] and got[0][0][-1] is not None
    plan = spectral._resampled(pairs, lags, 0.8, 16)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "Generate" not in plan


def test_gaussian_slots_equal_pairs(spark, lc):
    from math import exp

    from kilonova.operators import spectral

    rows = [r for r in lc.filter("object_id = 1 AND mjd < 8 AND flux IS NOT NULL").collect()]
    df = spark.createDataFrame(rows, lc.schema)
    got = {r.bin: r for r in spectral.discrete_correlation(df, None, 0, 1, -3.0, 3.0, 2.0, "gauss").collect()}
    a, b = ([r for r in rows if r.passband == p] for p in (0, 1))
    h = 0.5
    for k, centre in enumerate((-2.0, 0.0, 2.0)):
        pairs = [(x, y) for x in a for y in b if exp(-(y.mjd - x.mjd - centre) ** 2 / (2 * h * h)) >= exp(-3.290527 ** 2 / 2)]
        n, mx, my = len(pairs), sum(x.flux for x, _ in pairs) / len(pairs), sum(y.flux for _, y in pairs) / len(pairs)
        vx, vy = sum((x.flux - mx) ** 2 for x, _ in pairs) / n, sum((y.flux - my) ** 2 for _, y in pairs) / n
        ex, ey = sum(x.flux_err for x, _ in pairs) / n, sum(y.flux_err for _, y in pairs) / n
        den = ((vx - ex * ex) * (vy - ey * ey)) ** 0.5
        d = [(x.flux - mx) * (y.flux - my) / den for x, y in pairs]
        dcf = sum(d) / n
        assert got[k].n_pairs == n and got[k].dcf == pytest.approx(dcf, rel=1e-9, abs=1e-12)
        assert got[k].dcf_err == pytest.approx(sum((v - dcf) ** 2 for v in d) ** 0.5 / (n - 1), rel=1e-9)
