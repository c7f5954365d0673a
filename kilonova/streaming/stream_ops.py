"""Structured Streaming forms of the feature operators (ST1-ST5).

The reference's chunk loop with keyed carry-over becomes: a file stream of
observations (``readStream``), keyed state in the state store, watermarks for
late rows and micro-batches.  Every operator returns a *streaming* DataFrame;
``run_to_table`` drives a query to completion (``availableNow``).  Given the
same ``path`` again, a restarted job resumes from its checkpoint, and a batch
that is replayed replaces its own rows.
"""
from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import safe_div
from ..functions.windows import join_back, lag_columns
from ..session import ensure_checkpoint_dir

MJD_UNIX_EPOCH = 40587.0  # MJD of 1970-01-01T00:00:00Z


def mjd_to_instant(mjd) -> F.Column:
    """MJD -> TIMESTAMP instant (UTC), independent of the session time zone."""
    return F.timestamp_micros(F.round((F.col(mjd) - F.lit(MJD_UNIX_EPOCH)) * F.lit(86400e6)).cast("long"))


def instant_to_mjd(ts) -> F.Column:
    """TIMESTAMP instant -> MJD (UTC), independent of the session time zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c) / F.lit(86400e6) + F.lit(MJD_UNIX_EPOCH)


LC_STREAM_SCHEMA = T.StructType([
    T.StructField("object_id", T.LongType()),
    T.StructField("mjd", T.DoubleType()),
    T.StructField("passband", T.IntegerType()),
    T.StructField("flux", T.DoubleType()),
    T.StructField("flux_err", T.DoubleType()),
    T.StructField("detected", T.IntegerType()),
    T.StructField("ts", T.TimestampType()),
])


END_MARKER_ID = -1


#: rows of a staged file
FILE_ROWS = 5_000_000


def _n_files(spark: SparkSession, base: str) -> int:
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(path, "part-*"))
    return len(found) if found is not None else 0


def stage_observations(lc: DataFrame, n_files: int = 8, path: str | None = None, end_marker: bool = False,
                       arrival: list[int] | None = None) -> tuple[str, int]:
    """Write observations as ``n_files`` time slices of parquet files under the
    shared checkpoint folder (the landing zone a stream reads), one slice after
    the other so that arrival order is event-time order; ``arrival`` gives
    another order of the slices.  Slices of more than ``FILE_ROWS`` rows on average
    become several files each, all over the slice's whole time range.  Returns the
    path and the files of a slice, the same for every slice: a stream must take so
    many files at a time, else the watermark passes rows of files still to come.
    Event time ``ts`` is the UTC instant of ``mjd``.

    ``end_marker`` appends one control row (object_id -1, far in the future) as
    a last file: it moves the watermark past every real event so that
    append-mode operators (session windows) emit their last windows.
    Consumers drop ``object_id = -1``."""
    spark = lc.sparkSession
    base = path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/landing-{uuid.uuid4().hex[:12]}"
    n, lo, hi = lc.agg(F.count(F.lit(1)), F.min("mjd"), F.max("mjd")).first()  # three numbers
    if not n:
        lc.withColumn("ts", mjd_to_instant("mjd")).write.mode("append").parquet(base)
        return base, 1
    width = (hi - lo) / n_files if hi > lo else 1.0
    parts = max(1, -(-n // (n_files * FILE_ROWS)))
    sliced = lc.withColumns({
        "ts": mjd_to_instant("mjd"),
        "_slice": F.least(F.floor((F.col("mjd") - F.lit(lo)) / F.lit(width)), F.lit(n_files - 1)).cast("int"),
    })
    before = _n_files(spark, base) if parts > 1 else 0
    for i in arrival or range(n_files):
        rows = sliced.filter(F.col("_slice") == i).drop("_slice")
        (rows.repartition(parts).sortWithinPartitions("mjd")
         .write.mode("append").option("maxRecordsPerFile", 0).parquet(base))
        if parts > 1:  # a partition without rows leaves no file
            for _ in range(before + parts - _n_files(spark, base)):
                rows.limit(0).write.mode("append").parquet(base)
            before += parts
    if end_marker:
        marker = spark.range(1).select(
            F.lit(END_MARKER_ID).cast("long").alias("object_id"), F.lit(hi + 1000.0).alias("mjd"),
            F.lit(0).alias("passband"), F.lit(0.0).alias("flux"), F.lit(1.0).alias("flux_err"),
            F.lit(0).alias("detected"))
        marker.withColumn("ts", mjd_to_instant("mjd")).write.mode("append").parquet(base)
    return base, parts


def read_observation_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return (spark.readStream.schema(LC_STREAM_SCHEMA)
            .option("maxFilesPerTrigger", files_per_trigger).parquet(path))


def stream_object_stats(stream: DataFrame) -> DataFrame:
    """ST1: incremental per-object stats with mergeable aggregates only (update mode)."""
    r2 = F.pow(safe_div("flux", "flux_err"), 2.0)
    return stream.groupBy("object_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("flux").alias("flux_min"), F.max("flux").alias("flux_max"),
        F.avg("flux").alias("flux_mean"), F.stddev_samp("flux").alias("flux_std"),
        F.sum(r2).alias("flux_ratio_sq_sum"), F.sum(F.col("flux") * r2).alias("flux_by_flux_ratio_sq_sum"),
        F.avg("detected").alias("detected_mean"))


def stream_bucket_means(stream: DataFrame, width: str = "1 day", watermark: str = "2 days") -> DataFrame:
    """ST2: tumbling-window band means with a watermark for late rows."""
    w = F.window("ts", width)
    return (stream.withWatermark("ts", watermark)
            .groupBy("object_id", w.alias("w"), "passband")
            .agg(F.avg("flux").alias("flux_mean"), F.avg("flux_err").alias("flux_err_mean"),
                 F.count(F.lit(1)).alias("n")))


def stream_sessions(stream: DataFrame, gap: str = "1 day", watermark: str = "2 days") -> DataFrame:
    """ST3: gap sessions per object with the peak (max flux, earliest on ties)."""
    return (stream.withWatermark("ts", watermark)
            .groupBy("object_id", F.session_window("ts", gap).alias("s"))
            .agg(F.count(F.lit(1)).alias("n"), F.max("flux").alias("flux_max"),
                 F.min("mjd").alias("mjd_start"), F.max("mjd").alias("mjd_end"),
                 F.max_by("mjd", F.struct(F.col("flux"), -F.col("mjd"))).alias("peak_mjd")))


_RATE_STATE = "last_mjd double, last_flux double"
_RATE_OUT = "object_id long, passband int, mjd double, fluxdiff double, mjddiff double, late boolean"
#: a series without a new point for so long is forgotten; points older than the watermark by as much are dropped (and
#: counted by the stream's numRowsDroppedByWatermark)
RETENTION_DAYS = 400


def _rate_with_state(key, pdfs, state):
    """ST4 / ST5: per (object, band) carry the last point across micro-batches; a point older than it is late."""
    if state.hasTimedOut:
        state.remove()
        return
    pdf = pd.concat(list(pdfs), ignore_index=True).dropna(subset=["mjd"]).sort_values("mjd", kind="mergesort")
    last_mjd, last_flux = state.get if state.exists else (None, None)
    late = pdf["mjd"] < last_mjd if last_mjd is not None else pdf["mjd"] != pdf["mjd"]
    out = pdf[late].assign(fluxdiff=float("nan"), mjddiff=float("nan"), late=True)   # NULL in the result
    if len(out):
        yield out[["object_id", "passband", "mjd", "fluxdiff", "mjddiff", "late"]]
    pdf = pdf[~late]
    if not len(pdf):
        return
    prev_t = pdf["mjd"].shift(1)
    prev_f = pdf["flux"].shift(1)
    if last_mjd is not None:
        prev_t.iloc[0] = last_mjd
        prev_f.iloc[0] = last_flux
    dt = pdf["mjd"] - prev_t
    rate = (pdf["flux"] - prev_f) / dt.where(dt != 0)
    state.update((float(pdf["mjd"].iloc[-1]), float(pdf["flux"].iloc[-1])))
    state.setTimeoutTimestamp(int((pdf["mjd"].iloc[-1] - MJD_UNIX_EPOCH + RETENTION_DAYS) * 86_400_000))
    out = pd.DataFrame({"object_id": pdf["object_id"], "passband": pdf["passband"], "mjd": pdf["mjd"],
                        "fluxdiff": rate, "mjddiff": dt, "late": False})
    yield out[dt.notna()]


def stream_flux_rate(stream: DataFrame) -> DataFrame:
    """ST4 as one streaming DataFrame, for a sink of the caller (``run_flux_rates`` does the same without Python and splits
    long series): G21 (rate to the previous point of the same series) across batch boundaries, with the last point of every series in the state store (for
    ``RETENTION_DAYS``).  ST5: a point older than the state's comes out marked
    ``late``, without a rate, and leaves the state as it is."""
    return (stream.withWatermark("ts", f"{RETENTION_DAYS} days").groupBy("object_id", "passband")
            .applyInPandasWithState(_rate_with_state, _RATE_OUT, _RATE_STATE, "append", "EventTimeTimeout"))


_STATE = "object_id long, passband int, mjd double, flux double"


def flux_rates(batch: DataFrame, last: DataFrame) -> DataFrame:
    """ST4 / ST5 for one batch of points and the last points of the series before it, all in built-in functions: rate to
    the previous point of the series, in the batch or in ``last``; a point older than the one in ``last`` is late.  Lags run
    in time slices, so a series of any size is spread.  Points of one time are ordered by flux; points without a time are
    left out."""
    keys = ["object_id", "passband"]
    rows = join_back(batch.filter("mjd IS NOT NULL").select(*keys, "mjd", "flux"),
                     last.select(*keys, F.col("mjd").alias("_mjd"), F.col("flux").alias("_flux")), keys)
    rows = rows.withColumn("late", F.coalesce(F.col("mjd") < F.col("_mjd"), F.lit(False)))
    rows = lag_columns(rows, [*keys, "late"], "mjd", ["mjd", "flux"], "_prev_", ("flux",))
    first = F.col("_prev_mjd").isNull()
    then, value = F.when(first, F.col("_mjd")).otherwise(F.col("_prev_mjd")), F.when(first, F.col("_flux")).otherwise(F.col("_prev_flux"))
    step = F.when(~F.col("late"), F.col("mjd") - then)
    out = rows.select(*keys, "mjd", safe_div(F.col("flux") - value, step).alias("fluxdiff"), step.alias("mjddiff"), "late")
    return out.filter("late OR mjddiff IS NOT NULL")


def last_points(batch: DataFrame, last: DataFrame) -> DataFrame:
    """The last point of every series after a batch; at one time the batch's point (of the largest flux) is the later one."""
    both = last.withColumn("_new", F.lit(0)).unionByName(
        batch.filter("mjd IS NOT NULL").select("object_id", "passband", "mjd", "flux", F.lit(1).alias("_new")))
    newest = F.max(F.struct("mjd", "_new", "flux")).alias("_p")
    return both.groupBy("object_id", "passband").agg(newest).select("object_id", "passband", "_p.mjd", "_p.flux")


def run_flux_rates(stream: DataFrame, name: str = "rates", path: str | None = None) -> DataFrame:
    """Run ``flux_rates`` over a stream to completion and return its rows so far; ``path`` as in ``run_to_table``.

    The last points are a table of one row a series, written anew with every batch; nothing is forgotten, so no point is
    dropped for its age.  Batch ``i`` reads the table of batch ``i - 1`` and replaces its own folders, so a batch that is
    replayed after a failure gives the same rows once.  The tables of batches before the last two are deleted."""
    spark = stream.sparkSession
    base = path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{name}-{uuid.uuid4().hex[:12]}"
    spark.createDataFrame([], _RATE_OUT).write.mode("overwrite").parquet(f"{base}/table/_batch=-1")
    spark.createDataFrame([], _STATE).write.mode("overwrite").parquet(f"{base}/last/-1")

    def sink(batch: DataFrame, i: int) -> None:
        session = batch.sparkSession
        last = session.read.schema(_STATE).parquet(f"{base}/last/{i - 1}")
        flux_rates(batch, last).write.mode("overwrite").parquet(f"{base}/table/_batch={i}")
        last_points(batch, last).write.mode("overwrite").parquet(f"{base}/last/{i}")
        if i >= 2:
            old = session._jvm.org.apache.hadoop.fs.Path(f"{base}/last/{i - 2}")
            old.getFileSystem(session._jsc.hadoopConfiguration()).delete(old, True)

    q = (stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{base}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(f"{_RATE_OUT}, _batch long").parquet(f"{base}/table").drop("_batch")


def late_counts(rates: DataFrame) -> DataFrame:
    """ST5: late points per object, from the output of ``stream_flux_rate``."""
    return rates.groupBy("object_id").agg(F.count_if("late").alias("n_late"))


def run_to_table(sdf: DataFrame, name: str, output_mode: str = "update", key: list[str] | None = None,
                 path: str | None = None) -> DataFrame:
    """Run a streaming DataFrame to completion and return its result so far.

    Every micro-batch replaces the folder of its batch id in a parquet table by
    ``foreachBatch``, so a batch that is replayed after a failure leaves no
    second copy; for keyed update output the last version of each key is the
    result.  ``path``: a folder that all executors share; given again, the job
    goes on from its checkpoint there.  Default: a new folder under the shared
    checkpoint folder.
    """
    spark = sdf.sparkSession
    base = path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{name}-{uuid.uuid4().hex[:12]}"
    table = f"{base}/table"
    # the table exists, empty, before the first batch
    empty = spark.createDataFrame([], sdf.schema)
    empty.write.mode("overwrite").parquet(f"{table}/_batch=-1")

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/_batch={batch_id}")

    q = (sdf.writeStream.outputMode(output_mode).foreachBatch(sink)
         .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    out = spark.read.schema(T.StructType([*sdf.schema.fields, T.StructField("_batch", T.LongType())])).parquet(table)
    if key:
        last = F.max_by(F.struct(*[c for c in sdf.columns]), "_batch").alias("_r")
        return out.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg(last).select("_r.*")
    return out.drop("_batch")
