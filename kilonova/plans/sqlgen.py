"""Small helpers that write the DuckDB oracle SQL for the feature specs.

The oracle is an independent engine: these helpers only spell out the same
feature definitions (names, aggregate functions, filters) in SQL text.
"""
from __future__ import annotations

from collections.abc import Iterable, Mapping

_SQL_AGG = {
    "min": "min({x})",
    "max": "max({x})",
    "mean": "avg({x})",
    "sum": "sum({x})",
    "median": "median({x})",
    "std": "stddev_samp({x})",
    "std_pop": "stddev_pop({x})",
    "skew": "skewness({x})",
    "count": "count({x})",
}


def agg_sql(spec: Mapping[str, Iterable[str]], where: str | None = None, suffix: str = "",
            drop: Iterable[str] = ()) -> list[str]:
    drop = set(drop)
    out = []
    flt = f" FILTER (WHERE {where})" if where else ""
    for c, aggs in spec.items():
        for a in aggs:
            name = f"{c}_{a}{suffix}"
            if name in drop:
                continue
            out.append(f"{_SQL_AGG[a].format(x=c)}{flt} AS {name}")
    return out


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def ratio_sql(suffix: str = "") -> list[str]:
    mx, mn, mean = (f"flux_{a}{suffix}" for a in ("max", "min", "mean"))
    w = div(f"flux_by_flux_ratio_sq_sum{suffix}", f"flux_ratio_sq_sum{suffix}")
    return [
        f"{mx} - {mn} AS flux_diff{suffix}",
        f"{div(f'{mx} - {mn}', mean)} AS flux_dif2{suffix}",
        f"{w} AS flux_w_mean{suffix}",
        f"{div(f'{mx} - {mn}', w)} AS flux_dif3{suffix}",
    ]


RATIO_COLS_SQL = ("power(flux / nullif(flux_err, 0), 2) AS flux_ratio_sq, "
                  "flux * power(flux / nullif(flux_err, 0), 2) AS flux_by_flux_ratio_sq")


def snap_sql(x: str, bits: int = 20) -> str:
    """DuckDB twin of ``functions.core.snap`` (``bits`` significant binary digits)."""
    scale = f"pow(2, least({bits} - floor(log2(abs({x}))), 30))"
    return (f"CASE WHEN {x} = 0 OR round({x} * {scale}) = 0 THEN 0.0::DOUBLE WHEN {x} IS NULL THEN {x} "
            f"ELSE round({x} * {scale}) / {scale} END")


def rounded(query: str, keys: Iterable[str] = ("object_id",), bits: int = 20) -> str:
    """Snap every column except ``keys`` (which must list all non-double columns)."""
    keys = list(keys)
    if keys:
        ex = ", ".join(keys)
        return f"SELECT {ex}, {snap_sql(f'COLUMNS(* EXCLUDE ({ex}))', bits)} FROM ({query}) q_"
    return f"SELECT {snap_sql('COLUMNS(*)', bits)} FROM ({query}) q_"
