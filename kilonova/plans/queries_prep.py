"""Registered feature-matrix preparation and feature-store queries
(S5, S8, S15, P2, P7, P10-P15, M17, O7)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import prep, research, scaling, stats
from ..sources.adapters import lc_lineitem, meta_part, with_ctes
from ..sources.io import read_features, scratch_path, write_features
from .catalog import oracles, register
from .queries_features import object_stats_sql
from .sqlgen import rounded, snap_sql


def _ff_columns() -> list[str]:
    spec = stats.OBJECT_SPEC_NO_DETECTED
    names = [f"{c}_{a}" for c, aggs in spec.items() for a in aggs]
    names += [f"{n}_detected1" for n in names]
    names += [f"flux_{r}{s}" for s in ("", "_detected1") for r in ("diff", "dif2", "w_mean", "dif3")]
    return [n for n in names if n not in scaling.FLUXFACTOR_DROP]


def _assemble_sql() -> str:
    o = oracles()
    ff = ", ".join(f"ff.{c} AS {c}_fluxfactor" for c in _ff_columns())
    return (f"SELECT m.object_id, bm.* EXCLUDE (object_id), bt.* EXCLUDE (object_id), bp.* EXCLUDE (object_id), "
            f"{ff} FROM meta m LEFT JOIN ({o['basic_meta']}) bm ON bm.object_id = m.object_id "
            f"LEFT JOIN ({o['basic_ts']}) bt ON bt.object_id = m.object_id "
            f"LEFT JOIN ({o['basic_ts_passband']}) bp ON bp.object_id = m.object_id "
            f"LEFT JOIN ({o['fluxfactor']}) ff ON ff.object_id = m.object_id")


def _assembled(spark, sf_dir):
    lc, meta = lc_lineitem(spark, sf_dir), meta_part(spark, sf_dir)
    return prep.assemble_features(meta, [
        (research.basic_meta(meta), "", ""), (stats.basic_ts(lc), "", ""), (stats.basic_ts_passband(lc), "", ""),
        (scaling.fluxfactor(lc, meta), "", "_fluxfactor")])


@register("assemble_features", with_ctes(_assemble_sql(), lc=None, meta=True))
def q_assemble_features(spark, sf_dir):
    """S15 + J4 + P2: metadata, object, band and photoz^2-scaled feature sets joined by object_id."""
    return _assembled(spark, sf_dir)


# the feature table as it is (the registered query's oracle is this one, snapped)
_BASIC_TS = with_ctes(object_stats_sql("lc", detected_span=True, drop=("detected_mean_detected1",)), meta=True)


def _report_sql() -> str:
    cols = ["flux_min", "flux_max", "flux_mean", "flux_median", "flux_std", "flux_skew", "flux_err_min",
            "flux_err_max", "flux_err_mean", "flux_err_median", "flux_err_std", "flux_err_skew", "detected_mean",
            "flux_ratio_sq_sum", "flux_ratio_sq_skew", "flux_by_flux_ratio_sq_sum", "flux_by_flux_ratio_sq_skew",
            "diff_mjd_maxmin_detected1"]
    src = (f"(SELECT b.* FROM ({_BASIC_TS}) b JOIN meta m ON m.object_id = b.object_id "
           f"WHERE m.hostgal_photoz = 0)")
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS n_nonnull, stddev_pop({c}) AS std FROM {src}" for c in cols)
    return rounded(with_ctes(f"SELECT *, n_nonnull > 0 AND std != 0 AS keep FROM ({parts})", lc=None, meta=True),
                   keys=("\"column\"", "n_nonnull", "keep")), cols


@register("prune_report", _report_sql()[0])
def q_prune_report(spark, sf_dir):
    """Per column non-NULL count, population std and keep flag on the galactic split."""
    meta = meta_part(spark, sf_dir)
    bt = stats.basic_ts(lc_lineitem(spark, sf_dir), meta)
    gal = bt.join(meta.filter(F.col("hostgal_photoz") == 0).select("object_id"), "object_id", "left_semi")
    return prep.column_report(gal.select("object_id", *_report_sql()[1]))


_FILL = ["flux_std", "flux_skew", "flux_mean_detected1", "diff_mjd_maxmin_detected1", "flux_skew_detected1"]


def _fill_sql() -> str:
    flags = ", ".join(f"CAST({c} IS NULL AS INTEGER) AS missing_flg_{c}" for c in _FILL)
    fills = ", ".join(f"coalesce(b.{c}, avg(b.{c}) OVER (PARTITION BY d.domain)) AS {c}" for c in _FILL)
    return rounded(with_ctes(
        f"SELECT b.object_id, d.domain, {fills}, {flags} FROM ({_BASIC_TS}) b JOIN (SELECT object_id, "
        f"CASE WHEN hostgal_photoz = 0 THEN 'gal' ELSE 'exgal' END AS domain FROM meta) d ON d.object_id = b.object_id",
        lc=None, meta=True), keys=("object_id", "domain", *[f"missing_flg_{c}" for c in _FILL]))


@register("fill_and_flag", _fill_sql())
def q_fill_and_flag(spark, sf_dir):
    """P7 + P14 + P15: missing-indicator columns and per-domain mean filling."""
    meta = meta_part(spark, sf_dir)
    bt = stats.basic_ts(lc_lineitem(spark, sf_dir), meta)
    df = bt.join(meta.select("object_id", prep.domain_column(meta).alias("domain")), "object_id")
    out = prep.fill_and_flag(df.select("object_id", "domain", *_FILL), _FILL, split="domain")
    return out


_SCALE = ["hostgal_photoz", "hostgal_photoz_err", "distmod", "mwebv", "haversine", "latlon1"]


@register("scale_features", rounded(with_ctes(
    "SELECT object_id, " + ", ".join(f"({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0) AS {c}"
                                    for c in _SCALE) + " FROM bm", lc=None, meta=True,
    ctes=[("bm", "SELECT object_id, hostgal_photoz, hostgal_photoz_err, coalesce(distmod, 0) AS distmod, mwebv, "
                 "2 * asin(sqrt(power(sin((radians(gal_b) - radians(decl)) / 2), 2) + cos(radians(decl)) * "
                 "cos(radians(gal_b)) * power(sin((radians(gal_l) - radians(ra)) / 2), 2))) AS haversine, "
                 "radians(ra) * radians(decl) - radians(gal_l) * radians(gal_b) AS latlon1 FROM meta")])))
def q_scale_features(spark, sf_dir):
    """Standard scaling (population std) of the metadata features."""
    bm = research.basic_meta(meta_part(spark, sf_dir)).select("object_id", *_SCALE)
    return prep.standard_scale(bm, _SCALE)


@register("sample_objects", rounded(with_ctes(
    "SELECT * FROM lc WHERE object_id IN (SELECT object_id FROM meta ORDER BY md5(CAST(object_id AS VARCHAR) || ':71') "
    "LIMIT 100)", meta=True), keys=("object_id", "passband", "detected")))
def q_sample_objects(spark, sf_dir):
    """O7 + P6: all observations of 100 objects drawn in seeded hash order."""
    return prep.sample_observations(lc_lineitem(spark, sf_dir), meta_part(spark, sf_dir), 100, 71)


@register("domain_split", with_ctes(
    "SELECT CASE WHEN hostgal_photoz = 0 THEN 'gal' ELSE 'exgal' END AS domain, target, count(*) AS n FROM meta "
    "GROUP BY 1, 2", lc=None, meta=True))
def q_domain_split(spark, sf_dir):
    """Objects per (domain, class); every class falls in exactly one domain."""
    meta = meta_part(spark, sf_dir)
    return meta.groupBy(prep.domain_column(meta).alias("domain"), "target").agg(F.count(F.lit(1)).alias("n"))


@register("feature_store_roundtrip", with_ctes("SELECT * FROM (" + oracles()["basic_ts"] + ")", lc=None))
def q_feature_store_roundtrip(spark, sf_dir):
    """S8 + S5: basic_ts written to the parquet feature store (shared folder) and read back."""
    path = scratch_path(spark, "features-basic_ts")
    write_features(stats.basic_ts(lc_lineitem(spark, sf_dir), meta_part(spark, sf_dir)), path)
    return read_features(spark, path)


@register("row_audit", with_ctes(
    "SELECT CAST(sum(p.n) AS BIGINT) AS n_rows, count(p.n) AS n_objects_lc, count(m.object_id) AS n_objects_meta, "
    "count(*) FILTER (WHERE m.object_id IS NULL) AS only_in_lc, count(*) FILTER (WHERE p.n IS NULL) AS only_in_meta, "
    "count(DISTINCT coalesce(p.object_id, m.object_id)) AS n_objects_total FROM (SELECT object_id, count(*) AS n "
    "FROM lc GROUP BY 1) p FULL OUTER JOIN meta m ON m.object_id = p.object_id", lc="events", meta=False,
    ctes=[("meta", "SELECT c_custkey AS object_id FROM customer")]))
def q_row_audit(spark, sf_dir):
    """S4 / W3 / A8 audit: rows and objects of the events lc against a metadata key set
    (all customer keys as object ids: each side has objects the other lacks)."""
    from ..sources.adapters import lc_events, table
    meta = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("object_id"))
    return prep.row_audit(lc_events(spark, sf_dir), meta)


@register("head_per_class", with_ctes(
    "SELECT object_id, target FROM (SELECT object_id, target, row_number() OVER (PARTITION BY target ORDER BY "
    "object_id) AS rn FROM meta) WHERE rn <= 3", lc=None, meta=True))
def q_head_per_class(spark, sf_dir):
    """The first three objects of every class."""
    return prep.head_per_group(meta_part(spark, sf_dir).select("object_id", "target"), "target", ["object_id"], 3)


@register("order_audit", with_ctes(
    "SELECT count(*) AS n_rows, count(DISTINCT k) AS n_keys, count(*) FILTER (WHERE pk IS NULL OR pk <> k) AS n_runs, "
    "count(*) FILTER (WHERE k < pk) AS key_descents, count(*) FILTER (WHERE k = pk AND t < pt) AS time_descents FROM (SELECT k, t, "
    "lag(k) OVER (ORDER BY rn) AS pk, lag(t) OVER (ORDER BY rn) AS pt FROM (SELECT l_partkey AS k, l_shipdate AS t, row_number() OVER () AS rn FROM lineitem))",
    lc=None), bits=None)
def q_order_audit(spark, sf_dir):
    """Stored order of the observations by object and time."""
    from ..sources.adapters import table
    rows = prep.with_file_order(table(spark, sf_dir, "lineitem"))
    return prep.order_audit(rows.select("_file", "_row", F.col("l_partkey").alias("object_id"), F.col("l_shipdate").alias("mjd")))


@register("segment_two_means", rounded(with_ctes(
    "SELECT object_id, segment, count(*) AS n_rows, min(mjd) AS mjd_first, max(mjd) AS mjd_last FROM (SELECT d.object_id, d.mjd, CAST(sum(CASE WHEN d.step > b.step "
    "THEN 1 ELSE 0 END) OVER (PARTITION BY d.object_id ORDER BY d.mjd) AS INTEGER) AS segment FROM d LEFT JOIN best b ON b.object_id = d.object_id) GROUP BY 1, 2",
    lc="events", ctes=[
        ("d", "SELECT object_id, mjd, mjd - lag(mjd) OVER (PARTITION BY object_id ORDER BY mjd) AS step FROM lc"),
        ("cut", "SELECT object_id, step, count(*) OVER u AS n1, sum(step) OVER u AS s1, count(*) OVER a AS n, sum(step) OVER a AS s, max(step) OVER a AS top FROM d "
                "WHERE step IS NOT NULL WINDOW u AS (PARTITION BY object_id ORDER BY step), a AS (PARTITION BY object_id)"),
        ("gain", "SELECT *, s1 * s1 / n1 + (s - s1) * (s - s1) / (n - n1) - s * s / n AS gain FROM cut WHERE step < top"),
        ("best", f"SELECT object_id, step FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY {snap_sql('gain')} DESC, step) AS rn FROM gain) WHERE rn = 1")]),
    keys=("object_id", "segment", "n_rows")))
def q_segment_two_means(spark, sf_dir):
    """Segments of each object's series, cut at the steps of the long group of an exact two-means split."""
    from ..operators.peaks import segment_two_means
    from ..sources.adapters import lc_events
    return segment_two_means(lc_events(spark, sf_dir)).groupBy("object_id", "segment").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("mjd").alias("mjd_first"), F.max("mjd").alias("mjd_last"))
