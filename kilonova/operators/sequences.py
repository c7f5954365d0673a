"""Padded per-band sequences for sequence models.

A sequence is held as long rows (object, band, slot, value), slot counting the
points of a series in time order from 1, whatever its length: no task needs a
whole series (``sequence_rows``, ``scaled_rows``).  Scaling statistics are
mergeable aggregates of these rows, joined back; the band-level statistics and
max lengths are six-row tables (one per band) joined by broadcast.  Arrays and
padding exist only for a reader that wants them (``padded``; ``to_sequences``
and ``scaled_sequences`` end in it).

Points without a time have no slot and are no part of a sequence; points of one
time are ordered by their flux and error (NULL first).
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import pure_magnitude, safe_div
from ..functions.windows import join_back, lag_columns


def band_max_length(lc: DataFrame) -> DataFrame:
    """Longest series per band (six rows)."""
    return (lc.groupBy("object_id", "passband").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("passband").agg(F.max("n").alias("max_len")))


def padded(rows: DataFrame, cols: list[str], pad, lengths: DataFrame | None = None) -> DataFrame:
    """One array per channel of ``cols`` and (object, band) from long rows, in order of the slots, post-padded with ``pad``
    to the band's max length (``lengths``, default: that of the rows).  The arrays are as long as the longest series of the
    band, that is the shape of this output; what can do with long rows should take them as they are."""
    if lengths is None:
        lengths = band_max_length(rows)
    seq = rows.groupBy("object_id", "passband").agg(F.sort_array(F.collect_list(F.struct("slot", *cols))).alias("_s"))
    seq = seq.join(F.broadcast(lengths), "passband", "inner")
    out = [F.col("object_id"), F.col("passband"), F.size("_s").alias("length")]
    padding = F.array_repeat(F.lit(pad).cast("double"), (F.col("max_len") - F.size("_s")).cast("int"))
    return seq.select(*out, *[F.concat(F.col(f"_s.{c}"), padding).alias(c) for c in cols])


def long_rows(seq: DataFrame, cols: list[str]) -> DataFrame:
    """The long rows of padded arrays (the opposite of ``padded``; padding is left out by ``length``)."""
    cells = F.slice(F.arrays_zip(*cols), F.lit(1), F.col("length"))
    return (seq.select("object_id", "passband", F.posexplode(cells).alias("_p", "_c"))
            .select("object_id", "passband", (F.col("_p") + 1).cast("long").alias("slot"), *[F.col(f"_c.{c}").alias(c) for c in cols]))


def sequence_rows(lc: DataFrame) -> DataFrame:
    """Q1 in long form: t, flux, flux_err by (object, band, slot)."""
    rows = lc.select("object_id", "passband", "mjd", "flux", "flux_err").filter("mjd IS NOT NULL")
    rows = lag_columns(rows, ["object_id", "passband"], "mjd", ["mjd"], "_prev_", ("flux", "flux_err"), number="slot")
    return rows.select("object_id", "passband", "slot", F.col("mjd").alias("t"), "flux", "flux_err")


def to_sequences(lc: DataFrame) -> DataFrame:
    """Q1: per (object, band) arrays t, flux, flux_err sorted by time, NULL-padded
    to the band's max length (objects missing a band get no row for it)."""
    return padded(sequence_rows(lc), ["t", "flux", "flux_err"], None, band_max_length(lc.filter("mjd IS NOT NULL")))


def time_lags(lc: DataFrame) -> DataFrame:
    """Time step to the previous point of the series, first step 0, and the point's slot."""
    rows = lag_columns(lc.filter("mjd IS NOT NULL"), ["object_id", "passband"], "mjd", ["mjd"], "_prev_", ("flux", "flux_err"), number="slot")
    return rows.withColumn("lag", F.coalesce(F.col("mjd") - F.col("_prev_mjd"), F.lit(0.0))).drop("_prev_mjd")


def fit_flux_scaling(rows: DataFrame, col: str = "flux") -> DataFrame:
    """Q3 (flux part): per-band mean and population std over all points (six rows)."""
    return rows.groupBy("passband").agg(F.avg(col).alias("flux_mean"), F.stddev_pop(col).alias("flux_scale"))


def scaled_rows(lc: DataFrame, meta: DataFrame | None = None, flux_stats: DataFrame | None = None,
                magnitude: bool = True) -> DataFrame:
    """Q2-Q5 in long form, by (object, band, slot): flux as pure magnitude minus distmod (NULL distmod -> 0), time lags,
    flux scaled with per-band statistics (``flux_stats`` from the training
    split if given -- Q4 -- else fitted here -- Q3), lags scaled by the
    object's own mean / std, undefined values -> 0 (Q5), channels lag, flux,
    flux_err."""
    rows = lc
    if magnitude:
        if meta is not None:
            rows = rows.join(meta.select("object_id", F.coalesce("distmod", F.lit(0.0)).alias("_dm")),
                             "object_id", "inner")
        else:
            rows = rows.withColumn("_dm", F.lit(0.0))
        rows = rows.withColumn("flux", pure_magnitude("flux", "_dm")).drop("_dm")
    rows = time_lags(rows)
    stats = flux_stats if flux_stats is not None else fit_flux_scaling(rows)
    own = rows.groupBy("object_id", "passband").agg(F.avg("lag").alias("_lag_mean"), F.stddev_pop("lag").alias("_lag_scale"))
    return (join_back(rows, own, ["object_id", "passband"]).join(F.broadcast(stats), "passband", "inner")
            .select("object_id", "passband", "slot", *[c.alias(n) for n, c in {
                "lag": F.coalesce(safe_div(F.col("lag") - F.col("_lag_mean"), F.col("_lag_scale")), F.lit(0.0)),
                "flux": F.coalesce(safe_div(F.col("flux") - F.col("flux_mean"), F.col("flux_scale")), F.lit(0.0)),
                "flux_err": F.coalesce(F.col("flux_err"), F.lit(0.0)),
            }.items()]))


def scaled_sequences(lc: DataFrame, meta: DataFrame | None = None, flux_stats: DataFrame | None = None,
                     magnitude: bool = True) -> DataFrame:
    """``scaled_rows`` as arrays, padded with 0 (Q5)."""
    return padded(scaled_rows(lc, meta, flux_stats, magnitude), ["lag", "flux", "flux_err"], 0.0,
                  band_max_length(lc.filter("mjd IS NOT NULL")))


def mask_sequences(seq: DataFrame) -> DataFrame:
    """Q5: model input without the error channel (padding already 0)."""
    return seq.drop("flux_err")
