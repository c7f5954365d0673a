"""``lag`` over a series that may be huge, without one task per series.

The range of the order column is cut into slices (``functions.slices``); ``lag``
runs per (series, slice), and the first row of a slice takes the last row of the
series' previous non-empty slice (a table of at most one row per series and
slice).  Rows whose order value is NULL are no part of the series: they get
NULLs and are nobody's predecessor.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .slices import MOST_ROWS, cut_points, slice_sql, whole_keys


def lag_columns(df: DataFrame, keys: list[str], order: str, cols: list[str], prefix: str = "prev_",
                ties: tuple[str, ...] = (), rows: int | None = None, number: str | None = None) -> DataFrame:
    """Adds ``<prefix><c>`` = value of ``c`` on the previous row of the series (NULL first).
    ``ties``: further columns that order rows of equal ``order``.  ``number``: a column with the row's place in the series,
    from 1 (NULL where ``order`` is)."""
    cuts = cut_points(df, order, rows, keys)
    named = {f"{prefix}{c}": c for c in cols}
    df = df.withColumn("_slice", F.expr(slice_sql(f"`{order}`", cuts)))
    w = Window.partitionBy(*keys, "_slice").orderBy(order, *ties)
    out = df.withColumns({n: F.lag(c).over(w) for n, c in named.items()} | {"_place": F.row_number().over(w).cast("long")})
    before = F.lit(0)
    if cuts:
        by = F.struct(order, *ties)
        last = df.filter("_slice >= 0").groupBy(*keys, "_slice").agg(F.max_by(F.struct(*cols), by).alias("_last"), F.count(F.lit(1)).alias("_n"))
        wl = Window.partitionBy(*keys).orderBy("_slice")   # at most one row per slice
        carry = last.select(*keys, "_slice", F.lag("_last").over(wl).alias("_carry"),
                            F.sum("_n").over(wl.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
        out = join_back(out, carry.filter("_carry IS NOT NULL"), [*keys, "_slice"])
        out = out.withColumns({n: F.when(F.col("_place") == 1, F.col("_carry").getField(c)).otherwise(F.col(n)) for n, c in named.items()})
        before = F.coalesce("_before", F.lit(0))
    null = {n: F.when(F.col("_slice") >= 0, F.col(n)) for n in named}
    if number:
        null[number] = F.when(F.col("_slice") >= 0, F.col("_place") + before)
    return out.withColumns(null).drop("_slice", "_place", "_carry", "_before")


def circular_lag_columns(df: DataFrame, keys: list[str], order: str, cols: list[str], prefix: str = "prev_",
                         ties: tuple[str, ...] = (), rows: int | None = None) -> DataFrame:
    """``lag_columns`` on a circle: the first row of a series takes the series' last row (a single row: itself).
    NULL order values and NULL keys are as there."""
    out = lag_columns(df.withColumn("_here", F.lit(True)), keys, order, [*cols, "_here"], prefix, ties, rows).drop("_here")
    if keeps_whole(df, keys, rows):
        last = F.max_by(F.struct(*cols), F.when(F.col(order).isNotNull(), F.struct(order, *ties)))
        out = out.withColumn("_end", last.over(Window.partitionBy(*keys)))
        return _close_circle(out, order, cols, prefix)
    end = df.filter(F.col(order).isNotNull()).groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(order, *ties)).alias("_end"))
    return _close_circle(join_back(out, end, keys), order, cols, prefix)


def _close_circle(out: DataFrame, order: str, cols: list[str], prefix: str) -> DataFrame:
    first = F.col(order).isNotNull() & F.col(f"{prefix}_here").isNull()
    out = out.withColumns({f"{prefix}{c}": F.when(first, F.col("_end").getField(c)).otherwise(F.col(f"{prefix}{c}")) for c in cols})
    return out.drop("_end", f"{prefix}_here")


def nearest_columns(df: DataFrame, keys: list[str], order: str, tie: str, value: str, before: str, after: str, rows: int | None = None) -> DataFrame:
    """Adds ``before`` and ``after``: ``value`` of the last row with one at or before a row, and of the first at or after it,
    in order of (``order``, ``tie``); rows of one ``order`` and a smaller ``tie`` count on both sides.  Slices without such a
    row take it from the series' nearest slice that has one."""
    cuts = cut_points(df, order, rows, keys)
    df = df.withColumn("_slice", F.expr(slice_sql(f"`{order}`", cuts)))
    upto = (Window.unboundedPreceding, Window.currentRow)
    w = Window.partitionBy(*keys, "_slice")
    out = df.withColumns({before: F.last(value, ignorenulls=True).over(w.orderBy(order, tie).rowsBetween(*upto)),
                          after: F.last(value, ignorenulls=True).over(w.orderBy(F.desc(order), tie).rowsBetween(*upto))})
    if cuts:
        ends = df.groupBy(*keys, "_slice").agg(F.expr(f"max_by({value}, `{order}`) FILTER (WHERE {value} IS NOT NULL) AS _end"),
                                               F.expr(f"min_by({value}, `{order}`) FILTER (WHERE {value} IS NOT NULL) AS _begin"))
        by = Window.partitionBy(*keys).orderBy("_slice")   # at most one row per slice
        ends = ends.select(*keys, "_slice", F.last("_end", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"),
                           F.first("_begin", ignorenulls=True).over(by.rowsBetween(1, Window.unboundedFollowing)).alias("_later"))
        out = join_back(out, ends, [*keys, "_slice"])
        out = out.withColumns({before: F.coalesce(before, "_earlier"), after: F.coalesce(after, "_later")}).drop("_earlier", "_later")
    return out.drop("_slice")


def running_sums(df: DataFrame, keys: list[str], order: str, tie: str, sums: dict[str, str], rows: int | None = None) -> DataFrame:
    """Adds, per name of ``sums``, the running sum of its SQL value (NULL counts as 0) up to and with a row, in order of
    (``order``, ``tie``): sums within the slice and the total of the series' slices before it."""
    cuts = cut_points(df, order, rows, keys)
    df = df.withColumn("_slice", F.expr(slice_sql(f"`{order}`", cuts)))
    w = Window.partitionBy(*keys, "_slice").orderBy(order, tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.withColumns({n: F.coalesce(F.sum(F.expr(x)).over(w), F.lit(0.0)) for n, x in sums.items()})
    if cuts:
        totals = df.groupBy(*keys, "_slice").agg(*[F.sum(F.expr(x)).alias(f"_t_{n}") for n, x in sums.items()])
        by = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)   # at most one row per slice
        carry = totals.select(*keys, "_slice", *[F.sum(f"_t_{n}").over(by).alias(f"_c_{n}") for n in sums])
        out = join_back(out, carry, [*keys, "_slice"])
        out = out.withColumns({n: F.col(n) + F.coalesce(f"_c_{n}", F.lit(0.0)) for n in sums}).drop(*[f"_c_{n}" for n in sums])
    return out.drop("_slice")


def keeps_whole(df: DataFrame, keys: list[str], rows: int | None = None) -> bool:
    """Whether ``df`` is a long table of small keys, known from ``slices.sized`` (no job)."""
    return any(MOST_ROWS in df.schema[k].metadata for k in keys) and whole_keys(df, keys, rows)


def key_values(df: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """Rows of ``df`` with aggregates of their key: over a window where all keys are small (it shares their exchange), else
    by ``join_back``."""
    if keeps_whole(df, keys):
        w = Window.partitionBy(*keys)
        return df.withColumns({n: v.over(w) for n, v in values.items()})
    return join_back(df, df.groupBy(*keys).agg(*[v.alias(n) for n, v in values.items()]), keys)


def join_back(df: DataFrame, per_key: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``df`` with the values of their key (NULL is a key, too).  ``per_key`` is a mergeable aggregate, one row
    per key; a plain join lets AQE broadcast it by its measured size or split the rows of a huge key."""
    named = per_key.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    same = [df[k].eqNullSafe(named[f"_key_{k}"]) for k in keys]
    return df.join(named, same, "left").drop(*[f"_key_{k}" for k in keys])
