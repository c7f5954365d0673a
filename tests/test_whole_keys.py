"""A long table of small keys is dealt by object once and not cut: the same results, one exchange of its rows."""
import pytest

from kilonova.functions.core import round_all
from kilonova.functions.slices import MOST_ROWS, cut_points, whole_keys
from kilonova.functions import slices
from kilonova.operators import peaks, rates, series, stats
from kilonova.sources.adapters import lc_events, lc_lineitem

SF = "/root/testdata/sf0.001"


@pytest.fixture
def long_table(spark):
    spark.conf.set("kilonova.sliceRows", "900")   # the files of sf0.001 count as many slices, their keys as small
    yield
    spark.conf.unset("kilonova.sliceRows")


@pytest.mark.parametrize("adapter", [lc_lineitem, lc_events])
def test_small_keys_are_not_cut(spark, long_table, adapter):
    lc = adapter(spark, SF)
    most = lc.schema["object_id"].metadata[MOST_ROWS]
    assert max(r["count"] for r in lc.groupBy("object_id").count().collect()) <= most <= 900
    assert cut_points(lc, "mjd") and cut_points(lc, "mjd", None, ["object_id"]) == []
    assert not whole_keys(lc, ["object_id"], most - 1) and cut_points(lc, "mjd", most - 1, ["object_id"])   # a larger key is cut


@pytest.mark.parametrize("adapter,make", [
    (lc_lineitem, stats.basic_ts), (lc_lineitem, peaks.maxpoint), (lc_lineitem, lambda lc: peaks.maxpoint(lc, mode="window", width=200.0)),
    (lc_lineitem, lambda lc: peaks.segment_by_gap(lc, 50.0, "all")), (lc_events, rates.fluxdiffdiff), (lc_events, rates.fluxdiffdiff_passband),
], ids=["basic_ts", "maxpoint_gap", "maxpoint_window", "segments", "fluxdiffdiff", "fluxdiffdiff_passband"])
def test_one_exchange_and_the_same_results(spark, adapter, make):
    norm = lambda df: sorted((tuple(r) for r in round_all(df.select(sorted(df.columns))).collect()), key=repr)
    plain = norm(make(adapter(spark, SF)))
    spark.conf.set("kilonova.sliceRows", "900")
    try:
        out = make(adapter(spark, SF))
        assert norm(out) == plain
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    finally:
        spark.conf.unset("kilonova.sliceRows")


def test_medians_of_whole_keys_need_no_object_aggregate(spark, long_table):
    plan = stats.basic_ts(lc_lineitem(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan


def test_pairs_without_values_are_left_out(spark, make_lc):
    from kilonova.operators.buckets import timegrouper

    lc = make_lc([(1, 1.0, 0, 2.0, 1.0, 1), (1, 2.0, 5, 5.0, 1.0, 1), (2, 1.0, 3, 1.0, 1.0, 1)])
    got = {r.object_id: r for r in timegrouper(lc).collect()}
    assert set(got) == {1, 2}   # an object of one band has no pair, and stays
    assert got[1].flux_5_0_median == 3.0 and got[1].flux_2_1_median is None
    assert all(v is None for k, v in got[2].asDict().items() if k != "object_id")
    assert "IS NOT NULL" in timegrouper(lc)._jdf.queryExecution().analyzed().toString().upper().replace("ISNOTNULL", "IS NOT NULL")


def test_a_task_gets_a_bounded_part_of_a_long_table(spark, long_table, monkeypatch):
    from kilonova.functions import slices

    monkeypatch.setattr(slices, "PART_ROWS", 100)   # the session has four partitions
    lc = lc_lineitem(spark, SF)
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert lc.rdd.getNumPartitions() == -(-rows // 100)


@pytest.mark.parametrize("make", [rates.fluxdiffdiff, series.series_cadence, peaks.segment_two_means])
def test_steps_of_small_objects_never_run_their_input(spark, long_table, make, monkeypatch):
    lc = lc_events(spark, SF)
    monkeypatch.setattr(slices, "_rows_of", lambda *_: pytest.fail("a step counted its input"))
    make(lc)
