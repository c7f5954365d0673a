"""Late points, restarts and replays of the streaming operators."""
import random

import pytest
from pyspark.sql import functions as F

from kilonova.plans.queries_stream import N_FILES
from kilonova.session import ensure_checkpoint_dir
from kilonova.sources.adapters import lc_events
from kilonova.streaming import stream_ops as st
from tests.test_oracle import SF, equal_to_oracle

LC = "object_id long, mjd double, passband int, flux double, flux_err double, detected int"


def rates(spark, tmp, batches, path=None):
    for i, rows in enumerate(batches):
        st.stage_observations(spark.createDataFrame(rows, LC), 1, path=f"{tmp}/landing")
    return st.run_to_table(st.stream_flux_rate(st.read_observation_stream(spark, f"{tmp}/landing")), "t", "append", path=path)


def point(t, f, k=1, band=0):
    return (k, float(t), band, float(f), 1.0, 1)


def test_late_points_are_marked_and_leave_the_state(spark, tmp_path):
    got = rates(spark, tmp_path, [[point(60010, 1)], [point(60012, 3)], [point(60011, 9)], [point(60013, 4)]])
    assert sorted((r.mjd, r.mjddiff, r.fluxdiff, r.late) for r in got.collect()) == [
        (60011.0, None, None, True), (60012.0, 2.0, 1.0, False), (60013.0, 1.0, 1.0, False)]
    assert [tuple(r) for r in st.late_counts(got).collect()] == [(1, 1)]


def test_a_restart_goes_on_and_a_replay_adds_nothing(spark, tmp_path):
    rnd = random.Random(2)
    rows = [[point(60000 + 10 * b + i, rnd.gauss(0, 1), k) for i in range(5) for k in (1, 2)] for b in range(4)]
    path = f"{ensure_checkpoint_dir(spark)}/restart-{tmp_path.name}"
    first = rates(spark, tmp_path, rows[:2], path).count()
    again = rates(spark, tmp_path, [], path).count()
    assert first == again == 2 * 9
    whole = rates(spark, tmp_path, rows[2:], path)
    assert whole.count() == 2 * 19 and whole.filter("late").count() == 0
    once = rates(spark, f"{tmp_path}/b", rows)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(whole) == key(once)


def test_no_rows_give_an_empty_table_and_failures_show(spark, tmp_path):
    assert rates(spark, tmp_path, [[]]).count() == 0
    bad = st.read_observation_stream(spark, f"{tmp_path}/landing").select(F.raise_error(F.lit("no")).alias("object_id"))
    st.stage_observations(spark.createDataFrame([point(60000, 1)], LC), 1, path=f"{tmp_path}/landing")
    with pytest.raises(Exception):
        st.run_to_table(bad, "bad", "append")


@pytest.mark.parametrize("name", ["stream_buckets", "stream_sessions", "stream_rates", "stream_late"])
def test_slices_of_several_files_lose_no_rows(spark, monkeypatch, name):
    """Four files a slice, all over the slice's time range, equal the batch SQL."""
    n = lc_events(spark, SF).count()
    monkeypatch.setattr(st, "FILE_ROWS", -(-n // (4 * N_FILES)))
    staged = []
    stage = st.stage_observations
    monkeypatch.setattr(st, "stage_observations", lambda *a, **b: staged.append(stage(*a, **b)) or staged[-1])
    equal_to_oracle(spark, name)
    assert staged[0][1] == 4


def test_slices_with_few_rows_have_their_number_of_files(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(st, "FILE_ROWS", 1)
    rows = [point(60000 + i / 10, i, k) for i in range(10) for k in range(9)] + [point(60030, 1)]
    path, files = st.stage_observations(spark.createDataFrame(rows, LC), 3, path=f"{tmp_path}/few")
    assert len(list((tmp_path / "few").glob("part-*"))) == 3 * files == 93
    got = st.run_to_table(st.stream_bucket_means(st.read_observation_stream(spark, path, files)), "few", "update", key=["object_id", "w", "passband"])
    assert got.agg(F.sum("n")).first()[0] == len(rows)


def carried(spark, tmp, batches, path=None):
    for rows in batches:
        st.stage_observations(spark.createDataFrame(rows, LC), 1, path=f"{tmp}/landing")
    return st.run_flux_rates(st.read_observation_stream(spark, f"{tmp}/landing"), path=path)


def in_order(rows):
    return sorted(rows, key=lambda r: [(v is not None, v or 0) for v in r])


def cells(df):
    return in_order((r.object_id, r.passband, r.mjd, r.late, r.mjddiff, r.fluxdiff) for r in df.collect())


def expected(batches):
    """Point by point: the last point of every series, batches in order."""
    last, out = {}, []
    for rows in batches:
        before = dict(last)
        for k, t, b, f, *_ in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[3])):
            if (k, b) in before and t < before[k, b][0]:
                out.append((k, b, t, True, None, None))
                continue
            if (k, b) in last:
                t0, f0 = last[k, b]
                out.append((k, b, t, False, t - t0, (f - f0) / (t - t0) if t != t0 else None))
            last[k, b] = (t, f)
    return out


@pytest.mark.parametrize("cut", [None, 7])
def test_carried_rates_equal_a_point_by_point_run(spark, tmp_path, cut):
    """Late points, equal times, a point without a time, a huge series, restart between batches; one slice and many."""
    rnd = random.Random(8)
    batches = [[point(60000 + 20 * b + rnd.randint(-25, 20), rnd.randint(-9, 9), rnd.choice([1, 1, 1, 2, 3]), rnd.randint(0, 1))
                for _ in range(40)] for b in range(4)]
    batches = [list({(r[0], r[1], r[2]): r for r in rows}.values()) for rows in batches]   # one point a time and batch
    batches[2].append((1, None, 0, 1.0, 1.0, 1))
    if cut:
        spark.conf.set("kilonova.sliceRows", cut)
    try:
        path = f"{ensure_checkpoint_dir(spark)}/carried-{tmp_path.name}"
        carried(spark, tmp_path, batches[:2], path)
        got = cells(carried(spark, tmp_path, batches[2:], path))
    finally:
        spark.conf.unset("kilonova.sliceRows")
    want = in_order(expected(batches))
    assert [g[:5] for g in got] == [w[:5] for w in want] and any(w[3] for w in want) and any(w[4] == 0 for w in want)
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want])


def test_a_replayed_batch_gives_its_rows_once(spark, tmp_path):
    """The commit of the last batch is lost: the batch runs again from the last points before it."""
    batches = [[point(60000 + 10 * b + i, i * b, k) for i in range(4) for k in (1, 2)] for b in range(3)]
    path = tmp_path / "job"
    first = cells(carried(spark, tmp_path, batches, str(path)))
    for f in [path / "checkpoint/commits/2", path / "checkpoint/commits/.2.crc"]:
        f.unlink(missing_ok=True)
    assert cells(carried(spark, tmp_path, [], str(path))) == first == in_order(expected(batches))
    assert sorted(p.name for p in (path / "last").iterdir() if not p.name.startswith(".")) == ["-1", "1", "2"]   # -1: no points


def test_carried_rates_of_no_rows(spark, tmp_path):
    assert cells(carried(spark, tmp_path, [[]])) == []
