"""Periodogram from moment cells, harmonic fits, prewhitening and folded order."""
import math
import random

import numpy as np
import pytest

from kilonova.functions.windows import circular_lag_columns
from kilonova.operators import frequency as fr
from kilonova.operators import spectral

TONES = (1.7, 3.13, 0.61)


@pytest.fixture(scope="module")
def lc(spark):
    rnd = random.Random(1)

    def y(t):
        return (3 * math.sin(2 * math.pi * 1.7 * t) + math.cos(4 * math.pi * 1.7 * t + 0.3) + 1.5 * math.sin(2 * math.pi * 3.13 * t)
                + 0.8 * math.cos(2 * math.pi * 0.61 * t) + 0.02 * t + rnd.gauss(0, 0.05))

    ts = [(o, b, rnd.uniform(0, 40)) for o in (1, 2) for b in (0, 1) for _ in range(900 if (o, b) == (1, 0) else 250)]
    rows = [(o, 50000 + t, b, y(t), 1 + rnd.random(), 1) for o, b, t in ts]
    rows += [(3, 50000.0 + i, 0, 1.0, 1.0, 1) for i in range(30)]                       # constant: no power
    rows += [(4, 50010.0, 0, float(i), 1.0, 1) for i in range(30)]                      # a single time
    rows += [(5, 50000.0 + 3 * i, 1, float(i % 4), 1.0, 1) for i in range(7)]           # too few points for a fit
    rows += [(1, None, 0, 1.0, 1.0, 1), (1, 50001.0, 0, None, 1.0, 1), (1, 50002.0, 0, 9.0, 0.0, 1), (None, 50003.0, 1, 2.0, 1.0, 1)]
    return spark.createDataFrame(rows, "object_id long, mjd double, passband int, flux double, flux_err double, detected int")


@pytest.mark.parametrize("few", [0, 10**9])
def test_cells_equal_direct_sums(lc, few, monkeypatch):
    monkeypatch.setattr(fr, "FEW", few)
    some = lc.filter("object_id IN (1, 5) AND mjd IS NOT NULL AND flux IS NOT NULL")
    want = {}
    for r in spectral.periodogram_power(some).filter("power IS NOT NULL").collect():
        k = (r.object_id, r.passband)
        want[k] = max(want.get(k, (0, 0)), (r.power, r.freq))
    got = {(r.object_id, r.passband): r for r in fr.periodogram_peaks(some).collect()}
    assert set(got) == set(want) and len(got) == 3
    for k, (power, freq) in want.items():
        assert got[k].power_max == pytest.approx(power, rel=1e-9)
        if k[0] == 1:
            assert got[k].freq_best == pytest.approx(freq, rel=1e-12)


def test_planted_tones_and_odd_series(lc):
    got = {(r.object_id, r.passband): r for r in fr.series_frequency_long(lc).collect()}
    assert set(got) == {(o, b) for o in (1, 2) for b in (0, 1)}
    for r in got.values():
        assert [round(r[f"freq{i}_freq"], 1) for i in (1, 2, 3)] == [round(f, 1) for f in TONES]
        assert r.freq1_amplitude1 == pytest.approx(3, rel=0.2) and 0.4 < r.freq1_amplitude2 < 1.4
        assert r.freq_frequency_ratio_21 == pytest.approx(3.13 / 1.7, rel=0.02) and 0 < r.freq_varrat < 0.5 and r.freq_n_alias == 0
    assert got[1, 0].linear_trend == pytest.approx(0.02, abs=0.02)
    assert got[1, 0].scatter_res_raw < 1


def test_fit_equals_least_squares(spark, lc, monkeypatch):
    monkeypatch.setattr(fr, "RIDGES", (1e-3,))
    rows = fr.weighted_rows(lc.filter("object_id = 2"), 50000.0)
    freqs = spark.createDataFrame([(2, 0, 1.7), (2, 1, 0.9)], "object_id long, passband int, freq_best double")
    for r in fr.harmonic_fit(rows, freqs).collect():
        pts = rows.filter(f"passband = {r.passband}").collect()
        t, y, w = (np.array([p[c] for p in pts]) for c in ("t", "y", "w"))
        w = w / w.sum()
        x = np.stack([np.ones(len(t))] + [f(2 * np.pi * h * r.freq * t) for h in range(1, 5) for f in (np.cos, np.sin)], 1)
        want = np.linalg.solve(x.T @ (x * w[:, None]) + 1e-3 * np.diag([0] + [1] * 8), x.T @ (w * y))
        assert [r[n] for n in ["c"] + [f"{f}{h}" for h in range(1, 5) for f in "ab"]] == pytest.approx(want.tolist(), rel=1e-8, abs=1e-10)
        assert r["lambda"] == 1e-3 and r.n == len(t)
    left = fr.subtract_fit(rows, fr.harmonic_fit(rows, freqs)).collect()
    assert len(left) == 500


def test_series_in_slices(spark, lc):
    norm = lambda df: sorted((tuple(v if v is None else float(f"{v:.9g}") for v in r) for r in df.collect()), key=str)
    plain = norm(fr.series_frequency_long(lc))
    spark.conf.set("kilonova.sliceRows", "100")
    try:
        assert norm(fr.series_frequency_long(lc)) == plain
    finally:
        spark.conf.unset("kilonova.sliceRows")


def test_empty(spark, lc):
    none = lc.filter("false")
    assert fr.periodogram_peaks(none).count() == 0 and fr.multiband_periodogram(none).count() == 0
    assert fr.series_frequency_long(none).count() == 0
    wide = fr.series_frequency(none, lc.select("object_id").distinct())
    assert len(wide.columns) == 283 and wide.count() == 6


@pytest.mark.parametrize("rows", [None, 3])
def test_circular_order(spark, rows):
    pts = [(1, 0.9, "d"), (1, 0.1, "a"), (1, 0.5, "c"), (1, 0.3, "b"), (2, 0.4, "x"), (3, None, "n"), (1, None, "m")]
    df = spark.createDataFrame(pts, "k long, p double, v string")
    got = {r.v: r.prev_v for r in circular_lag_columns(df, ["k"], "p", ["v"], rows=rows).collect()}
    assert got == {"a": "d", "b": "a", "c": "b", "d": "c", "x": "x", "n": None, "m": None}


def test_large_series_are_counted_once(spark, lc, monkeypatch):
    from kilonova.functions import slices

    counted, old = [], slices._rows_of
    monkeypatch.setattr(slices, "_rows_of", lambda df, keys: counted.append(keys) or old(df, keys))
    spark.conf.set("kilonova.sliceRows", "100")
    try:
        assert len(fr.series_frequency_long(lc).collect()) == 4
    finally:
        spark.conf.unset("kilonova.sliceRows")
    assert counted == [["object_id", "passband"]]
