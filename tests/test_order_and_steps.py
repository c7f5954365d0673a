"""Stored-order audit, exact two-means of steps, lag products by transforms."""
import random

import numpy as np
import pytest

from kilonova.operators import peaks, prep, spectral

LC = "object_id long, mjd double, passband int, flux double, flux_err double, detected int"


def audit(rows):
    runs = sum(i == 0 or r[0] != rows[i - 1][0] for i, r in enumerate(rows))
    pairs = list(zip(rows, rows[1:]))
    return (len(rows), len({k for k, _ in rows if k is not None}), runs, sum(a[0] is not None and b[0] is not None and b[0] < a[0] for a, b in pairs),
            sum(a[0] == b[0] and a[1] is not None and b[1] is not None and b[1] < a[1] for a, b in pairs))


@pytest.mark.parametrize("chunk", [1, 3, 7, 1000])
def test_order_audit(spark, chunk, monkeypatch, tmp_path):
    monkeypatch.setattr(prep, "ORDER_CHUNK", chunk)
    rnd = random.Random(chunk)
    files = [[(rnd.choice([1, 1, 2, 3, None]), rnd.choice([0.5, 1.0, 2.0, None])) for _ in range(n)] for n in (20, 1, 13)]
    rows = [(f"f{i}", j, k, t) for i, f in enumerate(files) for j, (k, t) in enumerate(f)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "_file string, _row long, object_id long, mjd double").repartition(5)
    assert tuple(prep.order_audit(df).first()) == audit([x for f in files for x in f])
    assert tuple(prep.order_audit(df.filter("false")).first()) == (0, 0, 0, 0, 0)
    df.select("object_id", "mjd").coalesce(1).write.parquet(str(tmp_path / "t"))
    stored = prep.with_file_order(spark.read.parquet(str(tmp_path / "t")))
    want = [(r.object_id, r.mjd) for r in stored.orderBy("_row").collect()]
    assert tuple(prep.order_audit(stored).first()) == audit(want)


def two_means(steps):
    best = None
    for cut in sorted(set(steps))[:-1]:
        a, b = [s for s in steps if s <= cut], [s for s in steps if s > cut]
        sse = np.var(a) * len(a) + np.var(b) * len(b)
        if best is None or sse < best[0] - 1e-9:
            best = (sse, cut, a, b)
    return best


@pytest.mark.parametrize("slice_rows", [None, "40"])
def test_two_means_segments(spark, slice_rows):
    rnd = random.Random(5)
    rows, times = [], {}
    for o, n in ((1, 400), (2, 3), (3, 1), (4, 30)):
        t = 0.0
        for i in range(n):
            t += rnd.choice([1.0, 1.5, 2.0, 2.0]) if rnd.random() < 0.9 else rnd.choice([60.0, 90.0])
            times.setdefault(o, []).append(t)
            rows.append((o, t, i % 6, 1.0, 1.0, 1))
    rows += [(5, float(i), 0, 1.0, 1.0, 1) for i in range(9)] + [(4, None, 0, 1.0, 1.0, 1)]
    times[5] = [float(i) for i in range(9)]
    lc = spark.createDataFrame(rows, LC)
    if slice_rows:
        spark.conf.set("kilonova.sliceRows", slice_rows)
    try:
        got = {r.object_id: r for r in peaks.split_steps(lc).collect()}
        seg = {}
        for r in peaks.segment_two_means(lc).collect():
            seg.setdefault(r.object_id, []).append((r.mjd, r.segment))
    finally:
        spark.conf.unset("kilonova.sliceRows")
    for o, ts in times.items():
        steps = [b - a for a, b in zip(ts, ts[1:])]
        best = two_means(steps)
        assert (best is None) == (o not in got)
        if best:
            r = got[o]
            assert (r.split_step, r.n_short, r.n_long) == (best[1], len(best[2]), len(best[3]))
            assert r.mean_long == pytest.approx(np.mean(best[3]))
        cut = best[1] if best else float("inf")
        want, k = [], 0
        for i, t in enumerate(ts):
            k += i > 0 and steps[i - 1] > cut
            want.append((t, k))
        assert sorted(seg[o]) == want


def test_lag_products_equal_the_sums(make_lc):
    rnd = random.Random(9)
    series = {b: [rnd.gauss(0, 2) for _ in range(50)] for b in (0, 5)}
    lc = make_lc([(1, float(d), b, x, 1.0, 1) for b, xs in series.items() for d, x in enumerate(xs)])
    got = {r["rank"]: (r.lag, r.xcorr) for r in spectral.lagged_product(lc, pairs=[(0, 5)], top=99).collect()}
    full = np.correlate(series[0], series[5], "full")
    order = sorted(range(99), key=lambda i: -full[i])
    assert [got[k][0] for k in range(1, 100)] == [i - 49 for i in order]
    assert [got[k][1] for k in range(1, 100)] == pytest.approx([full[i] for i in order], rel=1e-9, abs=1e-9)
