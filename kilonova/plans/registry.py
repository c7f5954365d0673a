"""Feature-set and model registries.

A feature set is ``fn(lc, meta) -> DataFrame keyed by object_id``; one code
path serves train and test (defect B4 of the reference).  ``build`` assembles
a configured list of sets by key join (S15).
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators import (buckets, frequency, peaks, prep, rates, research, scaling, series, spectral, stats, template,
                         timing)

FeatureFn = Callable[[DataFrame, DataFrame], DataFrame]

FEATURE_SETS: dict[str, FeatureFn] = {
    "basic_meta": lambda lc, meta: research.basic_meta(meta),
    "basic_ts": lambda lc, meta: stats.basic_ts(lc, meta),
    "basic_ts_passband": lambda lc, meta: stats.basic_ts_passband(lc, meta),
    "fluxfactor": scaling.fluxfactor,
    "fluxfactor_passband": scaling.fluxfactor_passband,
    "fluxfactor_v2": scaling.fluxfactor_v2,
    "fluxfactor_passband_v2": scaling.fluxfactor_passband_v2,
    "maxpoint": lambda lc, meta: peaks.maxpoint(lc, meta, "gap", 100.0),
    "maxpoint_v2": lambda lc, meta: peaks.maxpoint(lc, meta, "window", 100.0),
    "maxpoint_passband": lambda lc, meta: peaks.maxpoint_passband(lc, meta),
    "maxpoint_passband_v2": peaks.maxpoint_passband_v2,
    "fluxfactor_maxpoint": peaks.fluxfactor_maxpoint,
    "fluxfactor_maxpoint_passband": peaks.fluxfactor_maxpoint_passband,
    "fluxdiff": lambda lc, meta: rates.fluxdiff(lc, meta),
    "fluxdiff_passband": lambda lc, meta: rates.fluxdiff_passband(lc, meta),
    "fluxdiffdiff": lambda lc, meta: rates.fluxdiffdiff(lc, meta),
    "fluxdiffdiff_passband": lambda lc, meta: rates.fluxdiffdiff_passband(lc, meta),
    "mjddiff_passband": lambda lc, meta: rates.mjddiff_passband(lc, meta),
    "timegrouper_14d": lambda lc, meta: buckets.timegrouper(lc, meta, 14.0),
    "time_mjddiff": lambda lc, meta: timing.time_above_quantile(lc, meta),
    "time_from_peak": lambda lc, meta: timing.time_from_peak(lc, meta),
    "diff_peak": lambda lc, meta: timing.diff_peak(lc, meta),
    "series_general": lambda lc, meta: series.series_general(lc, meta),
    "series_cadence": lambda lc, meta: series.series_cadence(lc, meta),
    "series_frequency": lambda lc, meta: frequency.series_frequency(lc, meta),
    "periodogram": lambda lc, meta: spectral.multiband_periodogram(lc, meta),
    "cross_correlation": lambda lc, meta: spectral.cross_correlation(lc, meta),
    "template_fit": lambda lc, meta: template.template_fit(lc, meta, template.learn_templates(lc, meta)),
}


def register_feature_set(name: str, fn: FeatureFn) -> None:
    """Add a user feature set."""
    FEATURE_SETS[name] = fn


def build(lc: DataFrame, meta: DataFrame, names: list[str], suffixes: dict[str, str] | None = None) -> DataFrame:
    """X7 + S15: the configured feature sets joined onto every object of ``meta``."""
    suffixes = suffixes or {}
    parts = [(FEATURE_SETS[n](lc, meta), "", suffixes.get(n, "")) for n in names]
    return prep.assemble_features(meta, parts)


def per_object(lc: DataFrame, fn, schema: str, keys=("object_id",)) -> DataFrame:
    """A user function over each object's rows (pandas), for logic the
    built-in operators cannot express.  Arrow-batched, one group per call."""
    return lc.groupBy(*keys).applyInPandas(fn, schema)


def model_registry() -> dict:
    """Estimators by name."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
    return {"random_forest": RandomForestClassifier, "mlp": MultilayerPerceptronClassifier}
