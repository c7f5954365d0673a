"""Readers, writers and small operators on hand-made rows."""
import json
import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from kilonova.functions.core import band_name, mjd_to_timestamp, timestamp_to_mjd
from kilonova.operators import buckets, evaluation, models, prep, sequences, spectral, template
from kilonova.plans import catalog, queries_eval, registry
from kilonova.sources import io

LC = "object_id long, mjd double, passband int, flux double, flux_err double, detected int"


@pytest.fixture
def lc(spark):
    rows = [(1, 60000.0 + i, i % 2, float(i), 1.0, i % 2) for i in range(8)] + [(2, 60000.5 + i, 1, 2.0 * i, 0.5, 1) for i in range(4)]
    return spark.createDataFrame(rows, LC)


# -- S1-S3, S6, S7, S9, S11-S13
def test_csv_readers_and_config(spark, tmp_path, lc):
    lc.union(spark.createDataFrame([(3, 60000.0, 0, float("nan"), 1.0, 0)], LC)).write.option("header", True).csv(f"{tmp_path}/lc")
    got = io.read_lc(spark, f"{tmp_path}/lc")
    assert got.count() == 13 and got.filter("flux IS NULL").count() == 1 and got.filter("isnan(flux)").count() == 0
    config = {"dataset": {"meta": {"train": "a.csv"}}, "importance": {"x": 1.0, "y": 2.0}}
    (tmp_path / "c.json").write_text(json.dumps(config, indent=1))
    read = io.read_config(spark, f"{tmp_path}/c.json")
    assert io.resolve(read, "meta", "train") == "a.csv" and io.prior_features(read) == ["x", "y"]
    assert io.prior_features({"features": ["b", "a"]}) == ["b", "a"]


def test_meta_reader_without_target(spark, tmp_path):
    cols = [f.name for f in io.META_SCHEMA.fields if f.name != "target"]
    (tmp_path / "m.csv").write_text(",".join(cols) + "\n" + ",".join("1" for _ in cols) + "\n")
    got = io.read_meta(spark, f"{tmp_path}/m.csv", with_target=False)
    assert got.columns == cols and got.first()["object_id"] == 1


def test_append_sink_and_sequences(spark, tmp_path, lc):
    io.write_features(lc.filter("object_id = 1"), f"{tmp_path}/f")
    io.write_features(lc.filter("object_id = 2"), f"{tmp_path}/f", mode="append")
    assert sorted(io.read_features(spark, f"{tmp_path}/f").collect()) == sorted(lc.collect())
    seq = sequences.to_sequences(lc)
    io.write_sequences(seq, f"{tmp_path}/s")
    assert io.read_sequences(spark, f"{tmp_path}/s").count() == 3 and io.read_sequences(spark, f"{tmp_path}/s", 0).count() == 1


def test_prediction_csv_has_fixed_decimals(spark, tmp_path):
    pred = spark.createDataFrame([(1, 0.000001, 1234567.5), (2, 1 / 3, None)], "object_id long, class_6 double, class_15 double")
    io.write_predictions_csv(pred, f"{tmp_path}/p")
    text = "".join(p.read_text() for p in sorted((tmp_path / "p").glob("*.csv")))
    assert "1,0.000001,1234567.500000" in text and "2,0.333333," in text and "E-" not in text


def test_json_result(spark, tmp_path):
    io.write_result_json(spark, spark.createDataFrame([(1, 0.5)], "n long, score double"), f"{tmp_path}/j")
    assert json.loads("".join(p.read_text() for p in (tmp_path / "j").glob("*.txt"))) == {"n": 1, "score": 0.5}


# -- functions
def test_time_and_band_names(spark):
    df = spark.createDataFrame([(60000.25, 5)], "mjd double, passband int")
    r = df.select(timestamp_to_mjd(mjd_to_timestamp("mjd")).alias("t"), band_name("passband").alias("b"), mjd_to_timestamp("mjd").cast("string").alias("s")).first()
    assert r.t == 60000.25 and r.b == "y" and r.s.startswith("2023-02-25 06:00")


def test_phase_fold(spark):
    df = spark.createDataFrame([(5.5, 2.0), (5.5, 0.0)], "mjd double, period double")
    assert [r.phase for r in spectral.phase_fold(df).collect()] == [0.75, None]


# -- preparation
def test_prune_align_stack_union(spark):
    train = spark.createDataFrame([(1, 1.0, 5.0, None), (2, 2.0, 5.0, None)], "object_id long, a double, b double, c double")
    test = spark.createDataFrame([(3, 9.0, 1.0, 2.0)], "object_id long, a double, b double, c double")
    a, b = prep.prune_columns(train, test)
    assert a.columns == b.columns == ["object_id", "a"]
    both = prep.stack_splits(a, b)
    assert sorted((r.object_id, r.split) for r in both.collect()) == [(1, "train"), (2, "train"), (3, "test")]
    assert prep.union_all([a, b, a]).count() == 5
    hot = prep.one_hot(spark.createDataFrame([(6,), (None,), (7,)], "target int"), "target", [15, 6]).collect()
    assert [(r.is_6, r.is_15) for r in hot] == [(1, 0), (0, 0), (0, 0)]


def test_wide_bucket_differences_equal_the_long_form(lc):
    pivot = buckets.bucket_pivot(lc, 3.0)
    wide = buckets.bucket_band_diff(pivot)
    long = {(r.object_id, r.bucket): r.flux for r in buckets.bucket_band_diff_long(pivot).filter("pair = '1_0'").collect()}
    got = {(r.object_id, r.bucket): r.flux_1_0 for r in wide.collect()}
    assert got == long and any(v is not None for v in got.values())


# -- sequences
def test_scaling_with_given_statistics_and_masking(spark, lc):
    stats = spark.createDataFrame([(0, 0.0, 2.0), (1, 0.0, 4.0)], "passband int, flux_mean double, flux_scale double")
    seq = sequences.scaled_sequences(lc, flux_stats=stats, magnitude=False)
    rows = {(r.object_id, r.passband): r for r in seq.collect()}
    assert rows[1, 0].flux == [0.0, 1.0, 2.0, 3.0] and rows[2, 1].flux == [0.0, 0.5, 1.0, 1.5]
    assert "flux_err" not in sequences.mask_sequences(seq).columns
    assert models.masked_mse(seq, seq).first()["masked_mse"] == 0.0


def test_an_absent_band_leaves_its_slots_zero(spark, lc, monkeypatch):
    seen = {}

    class Keep(models.PCA):
        def fit(self, df):
            seen.update({r.object_id: list(r.x) for r in df.select("object_id", "x").collect()})
            return super().fit(df)

    monkeypatch.setattr(models, "PCA", Keep)
    enc = models.encode_sequences(sequences.scaled_sequences(lc, magnitude=False), k=40).collect()
    assert all(len(r.encoding) == 40 for r in enc)
    assert len(seen[1]) == len(seen[2]) == 16 and seen[2][:8] == [0.0] * 8 and any(seen[2][8:]) and any(seen[1][:8])


# -- models and evaluation
def test_template_fit_uses_all_points(spark):
    rows = [(k, 60000.0 + 10 * i, b, float(10 - abs(i - 3)) * (1 + k % 3), 1.0, 1) for k in range(12) for b in (0, 1) for i in range(6)]
    lc = spark.createDataFrame(rows + [(90, 60000.0, 0, 5.0, 1.0, 1)], LC)
    meta = spark.createDataFrame([(k, 42 + 10 * (k % 2), 0.5) for k in range(12)] + [(90, 42, 0.5), (91, 42, 0.0)], "object_id long, target int, hostgal_photoz double")
    got = {r.object_id: r for r in template.template_fit(lc, meta, template.learn_templates(lc, meta)).collect()}
    assert got[90].best_template is None and got[91].best_template is None
    assert all(got[k].n_obs == 12 and got[k].n_used == 12 and got[k].best_shift == 0.0 and got[k].chi2 < 1.0 for k in range(12))


def test_evaluator_pseudo_labels_and_ensemble(spark):
    pred = spark.createDataFrame([(1, 6, Vectors.dense([0.8, 0.2])), (2, 15, Vectors.dense([0.5, 0.5]))], ["object_id", "target", "probability"])
    weights = spark.createDataFrame([(6, 1.0), (15, 3.0)], "target int, weight double")
    ev = models.WeightedLogLoss(weights, [15, 6])
    assert ev.evaluate(pred) == pytest.approx(-(math.log(0.8) + 3 * math.log(0.5)) / 4) and not ev.isLargerBetter()
    long = spark.createDataFrame([(8, 6, 0.95), (8, 15, 0.05), (9, 6, 0.5), (9, 15, 0.5)], "object_id long, class int, p double")
    train = spark.createDataFrame([(1, 15, 0.5)], "object_id long, target int, x double")
    test = spark.createDataFrame([(8, None, 1.0), (9, None, 2.0)], "object_id long, target int, x double")
    got = sorted((r.object_id, r.target, r.pseudo) for r in models.with_pseudo_labels(train, test, long).collect())
    assert got == [(1, 15, False), (8, 6, True)]
    mean = evaluation.ensemble_mean([long, long.withColumn("p", F.lit(0.0))])
    assert {(r.object_id, r["class"]): r.p for r in mean.collect()}[8, 6] == pytest.approx(0.475)


def test_feature_selection_keeps_the_useful_column(spark):
    rows = [(i, [6, 15][i % 2], float(i % 2), float((i * 7) % 5), float((i * 3) % 4)) for i in range(60)]
    df = spark.createDataFrame(rows, "object_id long, target int, good double, n1 double, n2 double")
    folds = df.select("object_id", (F.col("object_id") / 2).cast("int").alias("h")).select("object_id", (F.col("h") % 3).alias("fold"))
    weights = spark.createDataFrame([(6, 1.0), (15, 1.0)], "target int, weight double")
    score, cols = models.select_features(df, ["good", "n1", "n2"], folds, df.select("object_id", "target"), weights, [6, 15], step=1, rounds=1)
    assert "good" in cols and score < 0.3


def test_registry_builds_configured_sets(spark, lc):
    meta = lc.select("object_id").distinct()
    registry.register_feature_set("twice", lambda lc, meta: lc.groupBy("object_id").agg((F.max("flux") * 2).alias("twice")))
    out = registry.build(lc, meta, ["basic_ts", "twice"], {"twice": "_x"})
    assert {r.object_id: r.twice_x for r in out.collect()} == {1: 14.0, 2: 12.0} and "flux_median" in out.columns
    assert set(registry.model_registry()) == {"random_forest", "mlp"}


# -- lag correlations on duplicated and boundary points
def test_discrete_correlation_counts_equal_times_once(spark):
    rows = [(1, 10.0, 1, 1.0, 0.1, 1), (1, 10.0, 1, 2.0, 0.1, 1), (1, 10.0, 1, 2.0, 0.1, 1), (1, 11.0, 5, 1.0, 0.1, 1), (1, 11.5, 5, 3.0, 0.1, 1)]
    got = spectral.discrete_correlation(spark.createDataFrame(rows, LC)).collect()
    assert [(r.bin, r.n_pairs) for r in got] == [(5, 6)]


def test_interpolation_reaches_the_last_point(spark):
    rows = [(1, 10.0, 1, 7.0, 0.1, 1), (1, 8.0, 5, 1.0, 0.1, 1), (1, 10.0, 5, 3.0, 0.1, 1)]
    got = spectral.interpolated_pairs(spark.createDataFrame(rows, LC), 1, 5, [-2.0, -1.0, 0.0, 1.0]).collect()
    assert sorted((r.lag, r.y2) for r in got) == [(-2.0, 1.0), (-1.0, 2.0), (0.0, 3.0)]


def test_detrended_series_are_flat(spark):
    rows = [(1, 60000.0 + i, 1, 2.0 + 3 * i - 0.5 * i * i, 1.0 + i % 3, 1) for i in range(9)] + [(1, 60000.0, 5, 4.0, 1.0, 1)]
    lc = spark.createDataFrame(rows, LC)
    flat = [abs(r.resid) for r in spectral.detrend(lc, (1, 5), 2).filter("passband = 1").collect()]
    assert len(flat) == 9 and max(flat) < 1e-6
    one = [r.resid for r in spectral.detrend(lc, (1, 5), 1).filter("passband = 5").collect()]
    assert one == [None] and [r.resid for r in spectral.detrend(lc, (1, 5), 0).filter("passband = 5").collect()] == [0.0]


def test_periodogram_grid_follows_the_time_span(make_lc):
    """A period between the points of a 100-point grid is found, on a step of a fifth of a peak's width."""
    for span, period in ((30.0, 12.3), (300.0, 41.7)):
        t = np.sort(np.random.default_rng(3).uniform(0, span, 90))
        t[0], t[-1] = 0.0, span
        y = 10 * np.sin(2 * np.pi * t / period) + np.random.default_rng(4).normal(0, 0.5, 90)
        lc = make_lc([(1, float(a), 2, float(b), 1.0, 0) for a, b in zip(t, y)])
        first, step, n = spectral.span_grid(lc)
        assert first == 1 / span and step == 1 / (5 * span) and 10 - step < first + (n - 1) * step <= 10
        r = spectral.periodogram_peaks(lc).first()
        assert abs(r["freq_best"] - 1 / period) <= 1.5 * step and r["period_fast"] == 1 / r["freq_best"]
        assert spectral.multiband_periodogram(lc).first()["freq_best"] == r["freq_best"]
        assert spectral.periodogram_power(lc).count() == n


def test_out_of_fold_loss_counts_every_object(spark):
    sf = "/root/testdata/sf0.001"
    truth = queries_eval.meta_part(spark, sf).select("object_id", "target").collect()
    p = {(r.object_id, r["class"]): r.p for r in queries_eval._oof(spark, sf).collect()}
    n = {c: sum(r.target == c for r in truth) for c in {r.target for r in truth}}
    # the mean loss of a class over all its objects, averaged over the classes
    want = sum(-math.log(min(max(p.get((r.object_id, r.target), 0), 1e-15), 1 - 1e-15)) / n[r.target] for r in truth) / len(n)
    got = catalog.raw_queries()["frequency_logloss_oof"](spark, sf).first()
    assert got.loss == pytest.approx(want) and got.n_classes == len(n)
