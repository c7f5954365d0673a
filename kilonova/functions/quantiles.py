"""Exact quantiles for keys of any size.

Spark's exact ``percentile`` merges a map of all distinct values of a key in one
task.  Here the range of the values is cut into slices (``functions.slices``):

1. equal values collapse to (key, slice, value, count) -- mergeable, so a value
   that repeats a billion times is one row;
2. counts per (key, slice) and their running sums tell which slice holds the
   ranks around (n - 1) q;
3. only in those slices the values are ranked, each by its running count.

A table of one slice, or one of small keys only, takes one ``percentile`` per key.  Both give
the same numbers: the interpolation is Spark's own formula.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .slices import cut_points, one_slice, slice_rows, slice_sql, small_files, times_rows, whole_keys
from .windows import join_back, keeps_whole, key_values


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float], prefix: str = "_q",
                    rows: int | None = None) -> DataFrame:
    """``keys``, ``<prefix><i>``: exact quantile ``qs[i]`` (linear interpolation) of the non-NULL values per key;
    keys without a value have no row."""
    keys = list(keys)
    vals = df.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    if keeps_whole(vals, keys, rows):
        found = F.percentile("_v", F.array(*[F.lit(float(q)) for q in qs])).over(Window.partitionBy(*keys))
        return vals.withColumn("_a", found).groupBy(*keys).agg(*[F.max(F.col("_a")[i]).alias(f"{prefix}{i}") for i in range(len(qs))])
    cuts = cut_points(vals, "_v", rows, keys)
    if not cuts:
        got = vals.groupBy(*keys).agg(F.percentile("_v", F.array(*[F.lit(float(q)) for q in qs])).alias("_a"))
        return got.select(*keys, *[F.col("_a")[i].alias(f"{prefix}{i}") for i in range(len(qs))])
    tagged = vals.withColumn("_s", F.expr(slice_sql("_v", cuts)))
    values = tagged.groupBy(*keys, "_s", "_v").agg(F.count(F.lit(1)).alias("_c"))
    sizes = values.groupBy(*keys, "_s").agg(F.sum("_c").alias("_n"))
    by_key = Window.partitionBy(*keys)   # at most one row per slice
    sizes = sizes.withColumns({"_total": F.sum("_n").over(by_key), "_below": F.sum("_n").over(by_key.orderBy("_s")) - F.col("_n")})
    ranks = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), ((F.col("_total") - 1) * F.lit(float(q))).alias("pos")) for i, q in enumerate(qs)]))
    want = sizes.select(*keys, "_s", "_n", "_below", ranks.alias("_r")).select(
        *keys, "_s", "_n", "_below", F.col("_r.i").alias("_i"), F.col("_r.pos").alias("_pos"),
        F.explode(F.array(F.floor("_r.pos"), F.floor("_r.pos") + 1)).alias("_rank"))
    want = want.filter("_rank >= _below AND _rank < _below + _n").select(*keys, "_s", "_i", "_pos", "_rank", (F.col("_rank") - F.col("_below")).alias("_at"))
    asked = want.groupBy(*keys, "_s").agg(F.collect_list(F.struct("_i", "_pos", "_rank", "_at")).alias("_want"))   # two per quantile at most
    near = join_back(values, asked, [*keys, "_s"]).filter("_want IS NOT NULL")
    upto = F.sum("_c").over(Window.partitionBy(*keys, "_s").orderBy("_v"))
    near = near.withColumn("_upto", upto).select(*keys, "_v", "_c", "_upto", F.explode("_want").alias("_w"))
    near = near.filter("_w._at >= _upto - _c AND _w._at < _upto")
    picked = []
    for i, q in enumerate(qs):
        lo = f"max(CASE WHEN _w._i = {i} AND _w._rank = floor(_w._pos) THEN _v END)"
        hi = f"max(CASE WHEN _w._i = {i} AND _w._rank = floor(_w._pos) + 1 THEN _v END)"
        pos = f"max(CASE WHEN _w._i = {i} THEN _w._pos END)"
        picked.append(F.expr(f"CASE WHEN {pos} = floor({pos}) THEN {lo} ELSE (ceil({pos}) - {pos}) * {lo} + ({pos} - floor({pos})) * {hi} END")
                      .alias(f"{prefix}{i}"))
    return near.groupBy(*keys).agg(*picked)


def key_values_with_medians(df: DataFrame, keys: Sequence[str], values: dict[str, Column], medians: dict[str, str]) -> DataFrame:
    """Rows of ``df`` with aggregates and exact medians (name -> SQL value) of their key: over windows where all keys are
    small, so that one exchange and one sort serve them and later steps, else by ``join_back``."""
    keys = list(keys)
    if keeps_whole(df, keys):
        return key_values(df, keys, values | {n: F.expr(f"median({x})") for n, x in medians.items()})
    per = aggregate_with_medians(df, keys, [v.alias(n) for n, v in values.items()], {n: (x, None) for n, x in medians.items()})
    return join_back(df, per, keys)


def median_by_key(df: DataFrame, key: str, value: str, rows: int | None = None) -> DataFrame:
    """Exact per-key median."""
    return exact_quantiles(df, [key], value, [0.5], rows=rows).withColumnRenamed("_q0", "median")


def quantiles_by_key(df: DataFrame, key: str, value: str, qs: list[float], prefix: str = "_q", rows: int | None = None) -> DataFrame:
    return exact_quantiles(df, [key], value, qs, prefix, rows)


def aggregate_with_medians(df: DataFrame, keys: Sequence[str], aggs: list, medians: dict[str, tuple[str, str | None]],
                           order: Sequence[str] | None = None) -> DataFrame:
    """``df.groupBy(keys).agg(*aggs)`` plus exact medians: output name -> (SQL value, SQL condition or None).

    In a table of one slice the medians join the other aggregates; else all of
    them go through ``exact_quantiles`` at once as (key, name, value) rows."""
    keys = list(keys)
    cond = {n: v if c is None else f"CASE WHEN {c} THEN {v} END" for n, (v, c) in medians.items()}
    if medians and keeps_whole(df, keys):
        # medians over windows, so that the other aggregates run in generated code and no map is sorted or merged
        w = Window.partitionBy(*keys)
        df = df.withColumns({f"_{n}_of_key": F.expr(f"median({x})").over(w) for n, x in cond.items()})
        out = df.groupBy(*keys).agg(*aggs, *[F.max(f"_{n}_of_key").alias(n) for n in cond])
    elif not medians or small_files(df, slice_rows(df)) or whole_keys(df, keys) or one_slice(df):
        out = df.groupBy(*keys).agg(*aggs, *[F.expr(f"median({x}) AS `{n}`") for n, x in cond.items()])
    else:
        long = df.select(*keys, F.inline(F.array(*[F.struct(F.lit(i).alias("_name"), F.expr(f"CAST({x} AS DOUBLE)").alias("_x"))
                                                   for i, x in enumerate(cond.values())])))
        got = exact_quantiles(times_rows(long, keys[0], len(cond)), [*keys, "_name"], "_x", [0.5])
        wide = got.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == i, F.col("_q0"))).alias(n) for i, n in enumerate(cond)])
        base = df.groupBy(*keys).agg(*aggs) if aggs else df.select(*keys).distinct()
        out = join_back(base, wide, keys)
    return out.select(*keys, *order) if order else out
