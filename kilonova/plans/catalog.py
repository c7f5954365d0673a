"""Query catalogue: every registered query is a callable ``(spark, sf_dir) -> DataFrame``
over the driver's tables (through the adapters) plus, where SQL can express it,
the DuckDB oracle text.  ``__spark_entry__`` exposes both.

Registered queries run over whole tables; double outputs are snapped to 20
significant bits on both sides so that float noise from summation order cannot
flip a value hash.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.core import round_all

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_RAW: dict[str, QueryFn] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None, bits: int | None = 20):
    """Decorator: register ``fn(spark, sf_dir)`` as query ``name``."""

    def deco(fn: QueryFn) -> QueryFn:
        if bits is None:
            wrapped = fn
        else:
            def wrapped(spark, sf_dir, _fn=fn):
                return round_all(_fn(spark, sf_dir), bits)
            wrapped.__name__ = fn.__name__
            wrapped.__doc__ = fn.__doc__
        _QUERIES[name] = wrapped
        _RAW[name] = fn
        if oracle is not None:
            _ORACLES[name] = oracle
        return fn

    return deco


def queries() -> dict[str, QueryFn]:
    _load()
    return dict(_QUERIES)


def raw_queries() -> dict[str, QueryFn]:
    """The same queries without the output snapping used for the oracle check
    (what a pipeline would run; used by the benchmark)."""
    _load()
    return dict(_RAW)


def oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)


_LOADING = False


def _load() -> None:
    global _LOADING
    if _LOADING:
        return
    _LOADING = True
    # Importing the modules registers their queries.
    from . import (  # noqa: F401
        queries_eval, queries_features, queries_frequency, queries_models, queries_research, queries_sequences, queries_series,
        queries_spectral, queries_stream, queries_template,
        queries_time,
    )
    from . import queries_prep  # noqa: F401  (embeds other queries' oracle text)
