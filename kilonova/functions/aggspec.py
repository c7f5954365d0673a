"""Declarative aggregate spec ``{column: [agg, ...]}`` compiled to Spark aggregate
expressions.

Names follow ``<column>_<agg>[<suffix>]``.  A condition (SQL text) turns every
aggregate into a conditional one (``agg(CASE WHEN cond THEN x END)``) so that
several row subsets (all rows, detected rows, one band, ...) are aggregated in
the same ``groupBy`` -- one shuffle instead of one per subset plus a join.

Expressions are emitted as SQL text (``F.expr``): a wide feature set is a few
hundred expressions, and text is parsed once in the JVM instead of being
assembled from thousands of Python-to-JVM calls.
"""
from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

_AGG_SQL = {
    "min": "min({x})",
    "max": "max({x})",
    "mean": "avg({x})",
    "sum": "sum({x})",
    "median": "median({x})",
    "std": "stddev_samp({x})",
    "std_pop": "stddev_pop({x})",
    # bias-adjusted sample skewness (pandas): g1 * sqrt(n(n-1)) / (n-2); NULL for n < 3
    "skew": ("CASE WHEN count({x}) >= 3 THEN skewness({x}) * sqrt(CAST(count({x}) AS DOUBLE) * (count({x}) - 1)) "
             "/ (count({x}) - 2) END"),
    "count": "count({x})",
    "size": "count({x})",
}


def agg_text(name: str, x: str) -> str:
    if name not in _AGG_SQL:
        raise ValueError(f"unknown aggregate {name!r}")
    return _AGG_SQL[name].format(x=x)


def flat_name(column: str, agg: str, suffix: str = "") -> str:
    return f"{column}_{agg}{suffix}"


def split_spec(spec: Mapping[str, Iterable[str]], cond: str | None = None, suffix: str = "",
               drop: Iterable[str] = ()) -> tuple[list[Column], dict[str, tuple[str, str | None]], list[str]]:
    """The mergeable aggregates of a spec, its medians (output name -> (SQL value, condition)) and all output names in order."""
    spec = {c: list(a) for c, a in spec.items()}
    drop = set(drop)
    names = [n for c, aggs in spec.items() for a in aggs if (n := flat_name(c, a, suffix)) not in drop]
    medians = {n: (f"`{c}`", cond) for c, aggs in spec.items() if "median" in aggs and (n := flat_name(c, "median", suffix)) in names}
    return compile_aggs({c: [a for a in aggs if a != "median"] for c, aggs in spec.items()}, cond, suffix, drop), medians, names


def compile_aggs(spec: Mapping[str, Iterable[str]], cond: str | None = None,
                 suffix: str = "", drop: Iterable[str] = ()) -> list[Column]:
    """``cond`` is a SQL boolean expression (e.g. ``"detected = 1"``)."""
    drop = set(drop)
    out = []
    for c, aggs in spec.items():
        x = f"`{c}`" if cond is None else f"CASE WHEN {cond} THEN `{c}` END"
        for a in aggs:
            name = flat_name(c, a, suffix)
            if name in drop:
                continue
            out.append(F.expr(f"{agg_text(a, x)} AS `{name}`"))
    return out
