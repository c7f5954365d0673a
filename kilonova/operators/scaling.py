"""Row transforms that rescale flux by per-object metadata (G10, G13) and the
feature sets built on them (G11, G12, G14).

The metadata side is one row per object and only the needed column is
projected before the join; Spark broadcasts it when its size estimate is under
``spark.sql.autoBroadcastJoinThreshold`` and otherwise sort-merge joins it on
``object_id`` -- the same key the following ``groupBy`` uses, so the exchange
is shared.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import distmod_flat_lcdm
from . import stats


def extragalactic_ids(meta: DataFrame) -> DataFrame:
    """Objects with ``hostgal_photoz != 0``."""
    return meta.filter(F.col("hostgal_photoz") != 0).select("object_id")


def scale_by_photoz2(lc: DataFrame, meta: DataFrame) -> DataFrame:
    """Flux and flux_err times photoz^2 (extragalactic objects only; 0 -> NULL)."""
    dist = meta.filter(F.col("hostgal_photoz") != 0).select(
        "object_id", F.nullif(F.pow("hostgal_photoz", 2.0), F.lit(0.0)).alias("_dist"))
    return (lc.join(dist, "object_id", "inner")
            .withColumns({"flux": F.col("flux") * F.col("_dist"),
                          "flux_err": F.col("flux_err") * F.col("_dist")})
            .drop("_dist"))


def scale_by_distmod(lc: DataFrame, meta: DataFrame, distmod_col: str | None = "distmod",
                     z_col: str | None = None) -> DataFrame:
    """Shift magnitudes by the distance modulus, keep the sign of flux.

    -2.5*log10(|f|) - dm mapped back to flux is |f| * 10^(dm/2.5); likewise for
    flux_err.  The modulus comes from a meta column or from a redshift column
    through the flat-LCDM integral (F10).  Extragalactic objects only.
    """
    if z_col is not None:
        dm = distmod_flat_lcdm(F.col(z_col))
    else:
        dm = F.col(distmod_col)
    dist = meta.filter(F.col("hostgal_photoz") != 0).select("object_id", dm.alias("_dm"))
    factor = F.pow(F.lit(10.0), F.col("_dm") / 2.5)
    return (lc.join(dist, "object_id", "inner")
            .withColumns({"flux": F.col("flux") * factor, "flux_err": F.col("flux_err") * factor})
            .drop("_dm"))


FLUXFACTOR_DROP = ("flux_ratio_sq_sum", "flux_ratio_sq_skew",
                   "flux_ratio_sq_sum_detected1", "flux_ratio_sq_skew_detected1")


def fluxfactor(lc: DataFrame, meta: DataFrame) -> DataFrame:
    """Object stats (no detected column) on photoz^2-scaled flux; 36 columns."""
    return stats.object_stats(scale_by_photoz2(lc, meta), meta, detected=False, detected_variant=True,
                              drop=FLUXFACTOR_DROP)


def fluxfactor_passband(lc: DataFrame, meta: DataFrame) -> DataFrame:
    """Band stats, ratios and contrasts on photoz^2-scaled flux, nothing dropped; 89 columns."""
    return stats.band_features(scale_by_photoz2(lc, meta), meta, contrasts=True, drop_stats=())


def fluxfactor_v2(lc: DataFrame, meta: DataFrame, **kw) -> DataFrame:
    """G14 (object form): G11 on distance-modulus scaled flux."""
    return stats.object_stats(scale_by_distmod(lc, meta, **kw), meta, detected=False, detected_variant=True,
                              drop=FLUXFACTOR_DROP)


def fluxfactor_passband_v2(lc: DataFrame, meta: DataFrame, **kw) -> DataFrame:
    """G14 (band form): G9 on distance-modulus scaled flux; 65 columns."""
    return stats.band_features(scale_by_distmod(lc, meta, **kw), meta, contrasts=True)
