"""Hand-made inputs (FIXTURES.md part C) against hand / NumPy results."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kilonova.operators import evaluation, peaks, rates, spectral, stats, timing


def row(df, oid=1):
    return df.filter(F.col("object_id") == oid).first().asDict()


def test_one_point_is_null_not_error(make_lc):
    lc = make_lc([(1, 10.0, 0, 5.0, 1.0, 1)])
    r = row(stats.basic_ts(lc))
    assert r["flux_std"] is None and r["flux_skew"] is None
    assert r["flux_mean"] == 5.0 and r["flux_diff"] == 0.0
    assert rates.fluxdiff(lc).count() == 0  # no rate for a single point


def test_two_points_skew_null(make_lc):
    lc = make_lc([(1, 10.0, 0, 5.0, 1.0, 1), (1, 11.0, 0, 7.0, 1.0, 1)])
    r = row(stats.basic_ts(lc))
    assert r["flux_skew"] is None
    assert r["flux_std"] == pytest.approx(math.sqrt(2.0))


def test_constant_series(make_lc):
    lc = make_lc([(1, float(t), 0, 3.0, 1.0, 0) for t in range(5)])
    r = row(stats.basic_ts(lc))
    assert r["flux_std"] == 0.0 and r["flux_skew"] is None
    assert r["flux_dif2"] == 0.0 and r["flux_dif3"] == 0.0


def test_zero_mean_division_is_null(make_lc):
    lc = make_lc([(1, 1.0, 0, -1.0, 1.0, 0), (1, 2.0, 0, 0.0, 1.0, 0), (1, 3.0, 0, 1.0, 1.0, 0)])
    assert row(stats.basic_ts(lc))["flux_dif2"] is None


def test_skew_matches_pandas(make_lc):
    vals = [1.0, 2.0, 5.0, 3.0, 11.0, -4.0]
    lc = make_lc([(1, float(i), 0, v, 1.0, 0) for i, v in enumerate(vals)])
    import pandas as pd
    assert row(stats.basic_ts(lc))["flux_skew"] == pytest.approx(pd.Series(vals).skew())


def test_zero_err_ratio_ignored(make_lc):
    lc = make_lc([(1, 1.0, 0, 2.0, 0.0, 0), (1, 2.0, 0, 2.0, 1.0, 0)])
    r = row(stats.basic_ts(lc))
    assert r["flux_ratio_sq_sum"] == pytest.approx(4.0)


def test_no_detection_keeps_object(make_lc, spark):
    lc = make_lc([(1, 1.0, 0, 2.0, 1.0, 0), (1, 2.0, 1, 3.0, 1.0, 0)])
    ids = spark.createDataFrame([(1,), (2,)], "object_id long")
    out = stats.basic_ts(lc, ids)
    assert out.count() == 2
    r = row(out)
    assert r["flux_mean_detected1"] is None and r["diff_mjd_maxmin_detected1"] is None


def test_missing_band_columns_null(make_lc):
    lc = make_lc([(1, 1.0, 0, 2.0, 1.0, 0), (1, 2.0, 5, 3.0, 1.0, 0)])
    r = row(stats.band_features(lc, None, contrasts=True, drop_stats=()))
    assert r["flux_max_3"] is None and r["flux_max_diff_5_3"] is None
    assert r["flux_max_diff_5_0"] == pytest.approx(1.0)


def test_dup_time_rate_null(make_lc):
    lc = make_lc([(1, 1.0, 0, 2.0, 1.0, 0), (1, 1.0, 0, 3.0, 1.0, 0), (1, 2.0, 0, 5.0, 1.0, 0)])
    r = rates.flux_rate(lc).orderBy("mjd").collect()
    assert r[0]["fluxdiff"] is None  # zero step


def test_tie_peak_earliest_wins(make_lc):
    lc = make_lc([(1, 5.0, 0, 9.0, 1.0, 1), (1, 1.0, 1, 9.0, 1.0, 1), (1, 300.0, 0, 1.0, 1.0, 1)])
    rows = peaks.window_around_peak(lc, 100.0).collect()
    assert sorted(r["mjd"] for r in rows) == [1.0, 5.0]


def test_gap_edge_strict(make_lc):
    lc = make_lc([(1, 0.0, 0, 1.0, 1.0, 0), (1, 100.0, 0, 2.0, 1.0, 0), (1, 200.0001, 0, 9.0, 1.0, 0)])
    seg = peaks.segment_by_gap(lc, 100.0, keep="all").orderBy("mjd").collect()
    assert [r["segment"] for r in seg] == [0, 0, 1]
    # rates keep steps strictly below the gap
    assert rates.flux_rate(lc, 100.0).count() == 0


def test_window_edge_half_open(make_lc):
    lc = make_lc([(1, 100.0, 0, 9.0, 1.0, 0), (1, 0.0, 0, 1.0, 1.0, 0), (1, 200.0, 0, 1.0, 1.0, 0)])
    got = sorted(r["mjd"] for r in peaks.window_around_peak(lc, 100.0).collect())
    assert got == [0.0, 100.0]


def test_threshold_equal_strict(make_lc):
    # band 0 detected: min 0, max 10; level 0.5 -> thr 5; a later point exactly at 5 does not count
    lc = make_lc([(1, 0.0, 0, 0.0, 1.0, 1), (1, 1.0, 0, 10.0, 1.0, 1), (1, 2.0, 0, 5.0, 1.0, 1),
                  (1, 3.0, 0, 4.0, 1.0, 1)])
    r = row(timing.time_from_peak(lc))
    assert r["time_from_peak_after_thres0_5_pass0"] == pytest.approx(2.0)


def test_weighted_logloss_by_hand(spark):
    pred = spark.createDataFrame([(1, 6, 0.7), (1, 15, 0.3), (2, 6, 0.2), (2, 15, 0.8), (3, 6, 0.0), (3, 15, 1.0)],
                                 "object_id long, class int, p double")
    truth = spark.createDataFrame([(1, 6), (2, 15), (3, 6)], "object_id long, target int")
    w = spark.createDataFrame([(6, 1.0), (15, 2.0)], "target int, weight double")
    got = evaluation.weighted_logloss(pred, truth, w).first()["wloss"]
    l6 = (math.log(0.7) + math.log(1e-15)) / 2
    l15 = math.log(0.8)
    assert got == pytest.approx(-(1.0 * l6 + 2.0 * l15) / 3.0)


def test_unknown_class_mean(spark):
    pred = spark.createDataFrame([(1, 6, 0.5), (1, 15, 0.5), (2, 6, 0.9), (2, 15, 0.1)],
                                 "object_id long, class int, p double")
    out = {r["object_id"]: r["class_99"] for r in evaluation.unknown_class_score(pred).collect()}
    prods = {1: 0.25, 2: 0.09}
    m = sum(prods.values()) / 2
    for k, v in prods.items():
        assert out[k] == pytest.approx(0.18 * v / m)


def test_periodogram_finds_sine(make_lc):
    t = np.sort(np.random.default_rng(0).uniform(0, 60, 200))
    y = 10 * np.sin(2 * np.pi * 0.8 * t) + np.random.default_rng(1).normal(0, 0.5, 200)
    lc = make_lc([(1, float(a), 2, float(b), 1.0, 0) for a, b in zip(t, y)])
    r = spectral.periodogram_peaks(lc, f_min=0.05, df=0.05, n_freq=60).first()
    assert abs(r["freq_best"] - 0.8) <= 0.05


def test_cross_correlation_shift(make_lc):
    t = np.arange(0, 400, 2.0)
    f = lambda x: np.sin(x / 15.0) + 0.3 * np.cos(x / 7.0)
    rows = [(1, float(a), 1, float(f(a)), 1.0, 0) for a in t]
    rows += [(1, float(a), 5, float(f(a - 20.0)), 1.0, 0) for a in t + 1.0]
    r = spectral.cross_correlation(make_lc(rows), None, 1, 5, -100.0, 100.0, 10.0).first()
    assert r["peak_lag"] == 20.0


def test_cross_correlation_without_spread(make_lc, spark):
    """A lag at which a band is constant has no correlation (an error before); other lags and objects keep theirs."""
    b1, b5 = [(0.0, 3.0), (0.5, None), (1.0, 3.0), (2.0, 7.0)], [1.0, 4.0, 2.0, 8.0, 5.0]
    two = lambda i, first, other: [(i, t, 1, y, 1.0, 0) for t, y in first] + [(i, float(t), 5, y, 1.0, 0) for t, y in enumerate(other)]
    flat1, flat5 = [(t, 0.1) for t, _ in b1], [0.3] * 5
    lc = make_lc(two(1, b1, b5) + two(2, flat1, b5) + two(3, b1, flat5))
    ids = spark.createDataFrame([(1,), (2,), (3,), (4,)], "object_id long")
    for replicates in (0, 16):
        got = {r["object_id"]: r.asDict() for r in spectral.cross_correlation(lc, ids, 1, 5, 0.0, 4.0, 1.0, replicates=replicates).collect()}
        assert set(got) == {1, 2, 3, 4}
        for lag in range(3):
            want = np.corrcoef([3.0, 3.0, 7.0], b5[lag:lag + 3])[0, 1]
            assert got[1][f"r_lag_{lag}"] == pytest.approx(want, rel=1e-12)
        assert got[1]["r_lag_3"] is None and got[1]["r_lag_4"] is None   # 3, 3 against 8, 5; one pair
        for i in (2, 3, 4):
            assert all(v is None for c, v in got[i].items() if c != "object_id")
        assert not replicates or got[1]["success_ratio"] > 0


def test_cross_correlation_of_repeated_points(spark, tmp_path):
    """Six copies of every event: lags at which a user has one point and its copies are without spread."""
    import duckdb

    from kilonova.plans import catalog
    from tools.oracle_check import compare

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").crossJoin(spark.range(6).withColumnRenamed("id", "_copy"))
    events.withColumn("event_id", F.expr("event_id + 1000000 * _copy")).drop("_copy").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    got = catalog.queries()["cross_correlation"](spark, str(tmp_path))
    res = compare(got.toPandas(), con.execute(catalog.oracles()["cross_correlation"]).df(), dict(got.dtypes))
    assert res["columns_match"] and res["ok"], res


def test_missing_meta_inner_drops_restore_keeps(make_lc, spark):
    from kilonova.operators import scaling
    lc = make_lc([(1, 1.0, 0, 2.0, 1.0, 0), (3, 1.0, 0, 2.0, 1.0, 0)])
    meta = spark.createDataFrame([(1, 0.5, 40.0), (2, 0.3, 41.0)], "object_id long, hostgal_photoz double, distmod double")
    out = scaling.fluxfactor(lc, meta)
    assert sorted(r["object_id"] for r in out.collect()) == [1, 2]
    assert row(out, 2)["flux_mean"] is None


def test_registry_build_and_user_hook(make_lc, spark):
    from kilonova.plans import registry
    lc = make_lc([(1, 1.0, 0, 2.0, 1.0, 1), (1, 2.0, 0, 4.0, 1.0, 0), (2, 1.0, 1, 3.0, 1.0, 0)])
    meta = spark.createDataFrame([(1, 0.0), (2, 0.5), (3, 0.2)], "object_id long, hostgal_photoz double")
    out = registry.build(lc, meta, ["basic_ts", "fluxdiff"])
    assert out.count() == 3 and "fluxdiff_mean" in out.columns

    def span(pdf):
        import pandas as pd
        return pd.DataFrame({"object_id": [pdf.object_id.iloc[0]], "span": [pdf.mjd.max() - pdf.mjd.min()]})
    got = {r[0]: r[1] for r in registry.per_object(lc, span, "object_id long, span double").collect()}
    assert got == {1: 1.0, 2: 0.0}


def test_prediction_csv_and_json_sinks(spark, tmp_path):
    from kilonova.sources import io
    pred = spark.createDataFrame([(1, 0.1234567891, 0.5)], "object_id long, class_6 double, class_99 double")
    io.write_predictions_csv(pred, str(tmp_path / "pred"))
    back = spark.read.csv(str(tmp_path / "pred"), header=True, inferSchema=True).first()
    assert back["class_6"] == 0.123457
    io.write_result_json(spark, pred.select("class_99"), str(tmp_path / "res"))
    assert '"class_99":0.5' in spark.read.text(str(tmp_path / "res")).first()[0]
