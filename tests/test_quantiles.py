"""Exact quantiles from value slices equal Spark's exact percentile, for keys of any size."""
import random

import pytest
from pyspark.sql import functions as F

from kilonova.functions.quantiles import aggregate_with_medians, exact_quantiles, median_by_key
from kilonova.functions.slices import cut_points, slice_sql

QS = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]


@pytest.fixture(scope="module")
def values(spark):
    rnd = random.Random(5)
    rows = [(1, rnd.gauss(0, 1)) for _ in range(18001)] + [(2, float(rnd.randint(0, 3))) for _ in range(900)]
    rows += [(3, 7.0)] * 700 + [(k, rnd.random()) for k in range(4, 40) for _ in range(3)] + [(None, 1.0), (None, 2.0), (50, None), (1, None)]
    return spark.createDataFrame(rows, "object_id long, flux double")


def test_slices_partition_the_range(spark, values):
    cuts = cut_points(values, "flux", 500)
    assert len(cuts) > 10
    got = values.select(F.expr(slice_sql("flux", cuts)).alias("s"), "flux").groupBy("s").agg(F.count("*"), F.min("flux"), F.max("flux")).collect()
    got = {r[0]: r[1:] for r in got}
    assert got[-1][0] == 2 and all(lo >= cuts[s - 1] for s, (_, lo, _) in got.items() if s > 0)
    assert all(hi < cuts[s] for s, (_, _, hi) in got.items() if 0 <= s < len(cuts))


@pytest.mark.parametrize("rows", [50, 500, 10**9])
def test_quantiles_match_percentile(spark, values, rows):
    exp = {r[0]: r[1] for r in values.groupBy("object_id").agg(F.percentile("flux", F.array(*map(F.lit, QS)))).collect() if r[1]}
    got = {r[0]: list(r[1:]) for r in exact_quantiles(values, ["object_id"], "flux", QS, rows=rows).collect()}
    assert got == exp


def test_median_of_an_even_count(spark):
    df = spark.createDataFrame([(1, float(v)) for v in [5, 1, 9, 3, 7, 11]], "object_id long, flux double")
    for rows in (2, 100):
        assert median_by_key(df, "object_id", "flux", rows=rows).first()["median"] == 6.0


def test_medians_beside_other_aggregates(spark, values):
    spec = ["object_id"], [F.count("flux").alias("n")], {"m": ("flux", None), "p": ("flux", "flux > 0")}, ["m", "n", "p"]
    plain = sorted(aggregate_with_medians(values, *spec).collect(), key=str)
    spark.conf.set("kilonova.sliceRows", "300")
    try:
        assert sorted(aggregate_with_medians(values, *spec).collect(), key=str) == plain
    finally:
        spark.conf.unset("kilonova.sliceRows")
