"""Adapters that present the driver's tables as an observation table (lc) and
a metadata table (meta).  Both engines must build the same rows, so the
DuckDB form of every adapter is kept next to the Spark one
(``*_SQL``; used by the oracle queries).

Parquet scans only read the columns each adapter projects (column pruning is
visible as ``ReadSchema`` in ``explain``).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import timestamp_to_mjd
from ..functions.slices import MOST_ROWS, deal, sized, whole_keys


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def lc_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2,000 objects (parts) x 6 bands over 1995-2001; unique (object, mjd, band).

    The GROUP BY is needed because raw lineitem repeats (order, line) pairs.
    """
    li = table(spark, sf_dir, "lineitem")
    size = sized(li, "l_partkey")
    rows = (
        li.select(
            F.col("l_partkey").alias("object_id"),
            timestamp_to_mjd("l_shipdate").alias("mjd"),
            ((F.col("l_linenumber") - 1) % 6).cast("int").alias("passband"),
            ((F.col("l_extendedprice") - 20000) / 1000).alias("_flux"),
            (1 + 100 * F.col("l_tax")).alias("_err"),
            F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("_det"),
        )
    )
    return (
        _by_object(rows, size)
        .groupBy("object_id", "mjd", "passband")
        .agg(F.avg("_flux").alias("flux"), F.avg("_err").alias("flux_err"),
             F.max("_det").cast("int").alias("detected"))
    )


def _by_object(rows: DataFrame, size: tuple[int, int] | None) -> DataFrame:
    """A long table of small objects is dealt by object once: all steps per object or series share that exchange."""
    if size is None:
        return rows
    most, n = size
    rows = rows.withMetadata("object_id", {MOST_ROWS: most})
    return deal(rows, "object_id", n) if whole_keys(rows, ["object_id"]) else rows


def lc_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """150 users as objects over 30 days; ``ts`` is unique, no aggregation needed."""
    ev = table(spark, sf_dir, "events")
    size = sized(ev, "user_id")
    k = F.get_json_object("props", "$.k").cast("int")
    passband = (
        F.when(F.col("event_type") == "click", 0)
        .when(F.col("event_type") == "error", 1)
        .when(F.col("event_type") == "purchase", 2)
        .when(F.col("event_type") == "signup", 3)
        .otherwise(4 + k % 2)
    )
    rows = ev.select(
        F.col("user_id").alias("object_id"),
        timestamp_to_mjd("ts").alias("mjd"),
        passband.cast("int").alias("passband"),
        (F.col("value") - 20).alias("flux"),
        (1 + F.col("event_id") % 10).cast("double").alias("flux_err"),
        F.when(F.col("value") >= 50, 1).otherwise(0).cast("int").alias("detected"),
    )
    return _by_object(rows, size)


def lc_event_groups(spark: SparkSession, sf_dir: str, groups: int = 5) -> DataFrame:
    """The events of users with one remainder as one object: few long series."""
    return lc_events(spark, sf_dir).withColumn("object_id", F.col("object_id") % groups)


def meta_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One metadata row per part; joins ``lc_lineitem`` on object_id."""
    p = table(spark, sf_dir, "part")
    size = F.col("p_size")
    key = F.col("p_partkey")
    gal = size % 5 == 0
    return p.select(
        key.alias("object_id"),
        ((key * 37) % 360).cast("double").alias("ra"),
        (size - 25).cast("double").alias("decl"),
        ((key * 53) % 360).cast("double").alias("gal_l"),
        ((key * 29) % 180 - 90).cast("double").alias("gal_b"),
        F.when(size % 10 == 0, 1).otherwise(0).cast("int").alias("ddf"),
        F.when(size % 7 == 0, F.lit(None).cast("double")).when(gal, F.lit(0.0))
        .otherwise(size.cast("double") / 24).alias("hostgal_specz"),
        F.when(gal, F.lit(0.0)).otherwise(size.cast("double") / 25).alias("hostgal_photoz"),
        ((F.col("p_retailprice") - 900) / 1000).alias("hostgal_photoz_err"),
        F.when(gal, F.lit(None).cast("double"))
        .otherwise(5 * F.log10((4283 * size).cast("double") / 25) + 25).alias("distmod"),
        (size.cast("double") / 100).alias("mwebv"),
        F.when(gal, F.element_at(F.array(*[F.lit(c) for c in (6, 16, 53, 65, 92)]),
                                 (key % 5).cast("int") + 1))
        .otherwise(F.element_at(F.array(*[F.lit(c) for c in (15, 42, 52, 62, 64, 67, 88, 90, 95)]),
                                (key % 9).cast("int") + 1)).cast("int").alias("target"),
    )


def meta_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Object ids of the events adapter (all objects, for restore joins)."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("object_id")).distinct()


# ---------------------------------------------------------------------------
# DuckDB forms (oracle side).  ``{MJD}`` style helpers are inlined.

def _mjd_sql(x: str) -> str:
    return f"(date_diff('microsecond', TIMESTAMP '1858-11-17', {x}) / 86400000000.0)"


LC_LINEITEM_SQL = f"""
SELECT l_partkey AS object_id, {_mjd_sql('l_shipdate')} AS mjd, CAST((l_linenumber - 1) % 6 AS INTEGER) AS passband,
       avg((l_extendedprice - 20000) / 1000) AS flux, avg(1 + 100 * l_tax) AS flux_err,
       CAST(max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS INTEGER) AS detected
FROM lineitem GROUP BY 1, 2, 3
"""

LC_EVENTS_SQL = f"""
SELECT user_id AS object_id, {_mjd_sql('ts')} AS mjd,
       CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3
            ELSE 4 + CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 END AS INTEGER) AS passband,
       value - 20 AS flux, CAST(1 + event_id % 10 AS DOUBLE) AS flux_err,
       CAST(CASE WHEN value >= 50 THEN 1 ELSE 0 END AS INTEGER) AS detected
FROM events
"""

META_PART_SQL = """
SELECT p_partkey AS object_id,
       CAST((p_partkey * 37) % 360 AS DOUBLE) AS ra, CAST(p_size - 25 AS DOUBLE) AS decl,
       CAST((p_partkey * 53) % 360 AS DOUBLE) AS gal_l, CAST((p_partkey * 29) % 180 - 90 AS DOUBLE) AS gal_b,
       CAST(CASE WHEN p_size % 10 = 0 THEN 1 ELSE 0 END AS INTEGER) AS ddf,
       CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 5 = 0 THEN CAST(0 AS DOUBLE)
            ELSE CAST(p_size AS DOUBLE) / 24 END AS hostgal_specz,
       CASE WHEN p_size % 5 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(p_size AS DOUBLE) / 25 END AS hostgal_photoz,
       (p_retailprice - 900) / 1000 AS hostgal_photoz_err,
       CASE WHEN p_size % 5 = 0 THEN NULL ELSE 5 * log10(CAST(4283 * p_size AS DOUBLE) / 25) + 25 END AS distmod,
       CAST(p_size AS DOUBLE) / 100 AS mwebv,
       CAST(CASE WHEN p_size % 5 = 0
            THEN CASE p_partkey % 5 WHEN 0 THEN 6 WHEN 1 THEN 16 WHEN 2 THEN 53 WHEN 3 THEN 65 ELSE 92 END
            ELSE CASE p_partkey % 9 WHEN 0 THEN 15 WHEN 1 THEN 42 WHEN 2 THEN 52 WHEN 3 THEN 62 WHEN 4 THEN 64
                 WHEN 5 THEN 67 WHEN 6 THEN 88 WHEN 7 THEN 90 ELSE 95 END END AS INTEGER) AS target
FROM part
"""

LC_EVENT_GROUPS_SQL = f"SELECT * REPLACE (object_id % 5 AS object_id) FROM ({LC_EVENTS_SQL})"

META_EVENTS_SQL = "SELECT DISTINCT user_id AS object_id FROM events"


def with_ctes(body: str, lc: str | None = "lineitem", meta: bool = False,
              ctes: list[tuple[str, str]] | None = None) -> str:
    """Wrap an oracle query body with the adapter CTEs ``lc`` / ``meta`` and
    any extra ``(name, sql)`` CTEs (in order)."""
    parts = []
    if lc == "lineitem":
        parts.append(f"lc AS ({LC_LINEITEM_SQL})")
    elif lc == "events":
        parts.append(f"lc AS ({LC_EVENTS_SQL})")
    elif lc == "event_groups":
        parts.append(f"lc AS ({LC_EVENT_GROUPS_SQL})")
    if meta:
        parts.append(f"meta AS ({META_PART_SQL if lc != 'events' else META_EVENTS_SQL})")
    for name, sql in ctes or []:
        parts.append(f"{name} AS ({sql})")
    if not parts:
        return body
    return "WITH " + ",\n".join(parts) + "\n" + body
