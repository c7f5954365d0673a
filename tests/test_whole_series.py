"""Series features of a long table of small objects: nothing is cut or joined back, and the results stay."""
import math

import numpy as np
import pytest

from kilonova.functions.core import round_all
from kilonova.operators import frequency, series, walk
from kilonova.sources.adapters import lc_events

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted((tuple(r) for r in round_all(df.select(sorted(df.columns)), 20).collect()), key=repr)


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def _same(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            assert u == v or math.isclose(u, v, rel_tol=1e-5, abs_tol=1e-9), (x, y)


@pytest.mark.parametrize("make,most", [
    (series.series_general_long, 7), (series.series_cadence_long, 1), (walk.walk_fit, 1), (frequency.periodogram_peaks, 2),
], ids=["series_general", "series_cadence", "walk_fit", "periodogram"])
def test_small_objects_are_dealt_once(spark, make, most):
    plain = _rows(make(lc_events(spark, SF)))
    spark.conf.set("kilonova.sliceRows", "900")
    try:
        out = make(lc_events(spark, SF))
        assert _exchanges(out) <= most
        _same(_rows(out), plain)
    finally:
        spark.conf.unset("kilonova.sliceRows")


@pytest.mark.parametrize("n", [3, 40, 2500])
def test_power_of_points_is_the_power_of_cells(n):
    rng = np.random.default_rng(n)
    t, w = np.sort(rng.uniform(0, 30, n)), 1 / rng.uniform(1, 3, n) ** 2
    y = np.sin(2 * np.pi * 1.7 * t) + rng.normal(0, 0.3, n)
    grid = (1 / 30, 1 / 150, 1495)
    got = frequency._point_power(t, w, y, grid)
    for k in (0, 200, 1494):
        f = grid[0] + k * grid[1]
        a = np.stack([np.ones(n), np.cos(2 * np.pi * f * t), np.sin(2 * np.pi * f * t)], 1) * np.sqrt(w)[:, None]
        v = y * np.sqrt(w)
        rest = v - a @ np.linalg.lstsq(a, v, rcond=None)[0]
        flat = v - np.sqrt(w) * (w @ y / w.sum())
        assert np.isnan(got[k]) or abs(got[k] - (1 - rest @ rest / (flat @ flat))) < 1e-6
    assert np.isfinite(got).sum() > 1400


def test_frequency_set_of_small_objects(spark):
    plain = _rows(frequency.series_frequency_long(lc_events(spark, SF), f_max=2.0))
    spark.conf.set("kilonova.sliceRows", "900")
    try:
        _same(_rows(frequency.series_frequency_long(lc_events(spark, SF), f_max=2.0)), plain)
        assert plain
    finally:
        spark.conf.unset("kilonova.sliceRows")
