"""Registered streaming queries (ST1-ST5): each stages the events observations
as time-ordered files, runs the stream to completion in several micro-batches
and must equal the batch result (the oracle is the batch SQL)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.adapters import lc_events, with_ctes
from ..streaming import stream_ops as st
from .catalog import register
from .sqlgen import rounded

N_FILES = 6


def _stream(spark, sf_dir, end_marker=False):
    path, files = st.stage_observations(lc_events(spark, sf_dir), N_FILES, end_marker=end_marker)
    return st.read_observation_stream(spark, path, files_per_trigger=files)


@register("stream_stats", rounded(with_ctes(
    "SELECT object_id, count(*) AS n, min(flux) AS flux_min, max(flux) AS flux_max, avg(flux) AS flux_mean, "
    "stddev_samp(flux) AS flux_std, sum(power(flux / nullif(flux_err, 0), 2)) AS flux_ratio_sq_sum, "
    "sum(flux * power(flux / nullif(flux_err, 0), 2)) AS flux_by_flux_ratio_sq_sum, avg(detected) AS detected_mean "
    "FROM lc GROUP BY object_id", lc="events"), keys=("object_id", "n")))
def q_stream_stats(spark, sf_dir):
    """ST1: per-object stats maintained incrementally over 6 micro-batches (update mode)."""
    out = st.run_to_table(st.stream_object_stats(_stream(spark, sf_dir)), "stats", "update", key=["object_id"])
    return out


@register("stream_buckets", rounded(with_ctes(
    "SELECT object_id, floor(mjd) AS bucket_start_mjd, passband, avg(flux) AS flux_mean, "
    "avg(flux_err) AS flux_err_mean, count(*) AS n FROM lc GROUP BY 1, 2, 3", lc="events"),
    keys=("object_id", "passband", "n")))
def q_stream_buckets(spark, sf_dir):
    """ST2: 1-day tumbling-window band means with a watermark."""
    out = st.run_to_table(st.stream_bucket_means(_stream(spark, sf_dir)), "buckets", "update",
                          key=["object_id", "w", "passband"])
    return out.select("object_id", st.instant_to_mjd(F.col("w.start")).alias("bucket_start_mjd"), "passband",
                      "flux_mean", "flux_err_mean", "n")


_SESS_SQL = [
    ("s0", "SELECT *, CASE WHEN mjd - lag(mjd) OVER (PARTITION BY object_id ORDER BY mjd) >= 1.0 THEN 1 ELSE 0 END "
           "AS brk FROM lc"),
    ("s1", "SELECT *, sum(brk) OVER (PARTITION BY object_id ORDER BY mjd ROWS BETWEEN UNBOUNDED PRECEDING AND "
           "CURRENT ROW) AS sess FROM s0"),
    ("s2", "SELECT *, first_value(mjd) OVER (PARTITION BY object_id, sess ORDER BY flux DESC, mjd ASC) AS pk FROM s1"),
]


@register("stream_sessions", rounded(with_ctes(
    "SELECT object_id, count(*) AS n, max(flux) AS flux_max, min(mjd) AS mjd_start, max(mjd) AS mjd_end, "
    "any_value(pk) AS peak_mjd FROM s2 GROUP BY object_id, sess", lc="events", ctes=_SESS_SQL),
    keys=("object_id", "n")))
def q_stream_sessions(spark, sf_dir):
    """ST3: 1-day gap sessions per object with the peak."""
    out = st.run_to_table(st.stream_sessions(_stream(spark, sf_dir, end_marker=True)), "sessions", "append")
    return out.filter(F.col("object_id") != st.END_MARKER_ID).drop("s")


@register("stream_rates", rounded(with_ctes(
    "SELECT object_id, passband, mjd, fluxdiff, mjddiff FROM (SELECT object_id, passband, mjd, (flux - lag(flux) "
    "OVER w) / nullif(mjd - lag(mjd) OVER w, 0) AS fluxdiff, mjd - lag(mjd) OVER w AS mjddiff FROM lc "
    "WINDOW w AS (PARTITION BY object_id, passband ORDER BY mjd)) WHERE mjddiff IS NOT NULL", lc="events"),
    keys=("object_id", "passband")))
def q_stream_rates(spark, sf_dir):
    """ST4: rate to the previous point, the last point of each series carried from batch to batch."""
    return st.run_flux_rates(_stream(spark, sf_dir), "rates").filter("NOT late").drop("late")


ARRIVAL = [0, 2, 1, 3, 5, 4]


@register("stream_late", with_ctes(
    "SELECT object_id, count(*) FILTER (WHERE mjd < seen) AS n_late FROM (SELECT *, max(mjd) OVER (PARTITION BY object_id, passband "
    "ORDER BY arrival RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen, count(*) OVER (PARTITION BY object_id, passband) AS n "
    "FROM (SELECT lc.*, list_position([0, 2, 1, 3, 5, 4], CAST(least(floor((mjd - lo) / ((hi - lo) / 6)), 5) AS INTEGER)) AS arrival "
    "FROM lc, (SELECT min(mjd) AS lo, max(mjd) AS hi FROM lc))) WHERE n > 1 GROUP BY object_id", lc="events"), bits=None)
def q_stream_late(spark, sf_dir):
    """ST5: points that arrive after a later point of their series, counted per object (slices out of order)."""
    path, files = st.stage_observations(lc_events(spark, sf_dir), N_FILES, arrival=ARRIVAL)
    return st.late_counts(st.run_flux_rates(st.read_observation_stream(spark, path, files), "late"))
