"""Sequences in long form and their principal components against the direct forms."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kilonova.functions.slices import SLICE_ROWS_CONF
from kilonova.operators import components, models, sequences

LC = "object_id long, mjd double, passband int, flux double, flux_err double, detected int"
ROWS = "object_id long, passband int, slot long, lag double, flux double"


def series(n, most, seed=3, bands=2):
    rnd = random.Random(seed)
    return [(k, 60000 + 10 * i + rnd.random(), b, rnd.gauss(k % 3, 1), 1.0, 1)
            for k in range(n) for b in range(bands) for i in range(rnd.randint(1, most))]


def encodings(df):
    ids = sorted((r.object_id, r.encoding) for r in df.collect())
    return [i for i, _ in ids], np.array([e for _, e in ids])


def same_up_to_sign(a, b, tol):
    return all(min(np.abs(a[:, j] - b[:, j]).max(), np.abs(a[:, j] + b[:, j]).max()) <= tol for j in range(a.shape[1]))


def test_few_columns_equal_the_direct_components(spark):
    lc = spark.createDataFrame(series(40, 4), LC)
    ids, got = encodings(components.encode_rows(sequences.scaled_rows(lc, magnitude=False), 6))
    want_ids, want = encodings(models.encode_sequences(sequences.scaled_sequences(lc, magnitude=False), 6))
    assert ids == want_ids and same_up_to_sign(got, want, 1e-6)


def test_many_columns_of_a_strong_plane_equal_the_direct_components(spark):
    rng = np.random.default_rng(5)
    axes = np.linalg.qr(rng.normal(size=(150, 3)))[0].T
    x = rng.normal(size=(60, 3)) * [30, 14, 6] @ axes + rng.normal(size=(60, 150)) * 0.01 + 2.0
    cells = [(k, s % 3, s // 3 % 25 + 1, *map(float, (x[k, s], x[k, s + 75]))) for k in range(60) for s in range(75)]
    rows = spark.createDataFrame(cells, ROWS)
    _, got = encodings(components.encode_rows(rows, 3, extra=5))
    values, vectors = np.linalg.eigh(np.cov(x.T))
    assert same_up_to_sign(got, x @ vectors[:, ::-1][:, :3], 1e-3)
    _, moved = encodings(components.encode_rows(rows.repartition(7), 3, extra=5))
    assert same_up_to_sign(got, moved, 1e-6)


def test_one_long_series_is_no_matrix(spark, monkeypatch):
    """One object with 3,000 slots among objects of four: as many columns, no row or matrix of that width."""
    monkeypatch.setattr(components, "PLACE", 500)
    rnd = random.Random(1)
    cells = [(0, 0, s, rnd.gauss(0, 0.01), rnd.gauss(0, 0.01)) for s in range(1, 3001)]
    cells += [(k, 0, s, float(k % 5), float(k % 2)) for k in range(1, 50) for s in range(1, 5)]
    ids, got = encodings(components.encode_rows(spark.createDataFrame(cells, ROWS), 2, extra=4))
    x = np.zeros((50, 6000))
    for k, _, s, lag, flux in cells:
        x[k, s - 1], x[k, 3000 + s - 1] = lag, flux
    centred = x - x.mean(axis=0)
    _, _, v = np.linalg.svd(centred, full_matrices=False)
    assert ids == list(range(50)) and same_up_to_sign(got, x @ v[:2].T, 1e-3)


def test_odd_cells_and_tables(spark):
    assert components.encode_rows(spark.createDataFrame([], ROWS), 3).collect() == []
    one = components.encode_rows(spark.createDataFrame([(7, 0, 1, 1.0, 2.0)], ROWS), 3).collect()
    assert [(r.object_id, r.encoding) for r in one] == [(7, [0.0, 0.0, 0.0])]
    base = [(1, 0, 1, 1.0, 2.0), (2, 0, 1, 3.0, -1.0), (3, 0, 1, 0.0, 0.5)]
    odd = [(3, 0, 2, None, math.nan), (None, 0, 1, 9.0, 9.0), (4, None, 1, 9.0, 9.0), (5, 0, None, 9.0, 9.0)]
    _, want = encodings(components.encode_rows(spark.createDataFrame(base, ROWS), 2))
    ids, got = encodings(components.encode_rows(spark.createDataFrame(base + odd, ROWS).withColumn("encoding", F.lit(1)), 2))
    assert ids == [1, 2, 3] and same_up_to_sign(got, want, 1e-9)
    halves = [(i, b, s, a / 2, c / 2) for i, b, s, a, c in base * 2]
    assert same_up_to_sign(encodings(components.encode_rows(spark.createDataFrame(halves, ROWS), 2))[1], want, 1e-9)


@pytest.mark.parametrize("cut", [None, 25])
def test_slots_count_points_in_time_order(spark, cut):
    """Equal times, points without a time, and one object with most rows; one slice and many."""
    rows = series(6, 5) + [(99, 60000 + i * 0.5, 0, float(i), 1.0, 1) for i in range(300)]
    rows += [(99, 60010.0, 0, -5.0, 1.0, 1), (99, 60010.0, 0, None, 1.0, 1), (1, None, 0, 1.0, 1.0, 1)]
    random.Random(4).shuffle(rows)
    if cut:
        spark.conf.set(SLICE_ROWS_CONF, cut)
    try:
        lc = spark.createDataFrame(rows, LC)
        got = sorted((r.object_id, r.passband, r.slot, r.t, r.flux is None, r.flux or 0.0) for r in sequences.sequence_rows(lc).collect())
        lags = {(r.object_id, r.passband, r.slot): r.lag for r in sequences.time_lags(lc).collect()}
        arrays = {(r.object_id, r.passband): r for r in sequences.to_sequences(lc).collect()}
    finally:
        spark.conf.unset(SLICE_ROWS_CONF)
    want = []
    for key in sorted({(r[0], r[2]) for r in rows}):
        own = sorted((r[1], r[3] is not None, r[3] or 0.0) for r in rows if (r[0], r[2]) == key and r[1] is not None)
        want += [(*key, i, t, not there, f) for i, (t, there, f) in enumerate(own, 1)]
        assert [lags[(*key, i)] for i in range(1, len(own) + 1)] == [0.0] + [b[0] - a[0] for a, b in zip(own, own[1:])]
        assert arrays[key].length == len(own) and [t for t in arrays[key].t if t is not None] == [o[0] for o in own]
    assert got == want


def test_arrays_and_long_rows_are_the_same(spark):
    lc = spark.createDataFrame(series(8, 6), LC)
    rows = sequences.sequence_rows(lc)
    back = sequences.long_rows(sequences.padded(rows, ["t", "flux", "flux_err"], None), ["t", "flux", "flux_err"])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
