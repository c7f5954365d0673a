"""Feature-matrix preparation.

Column decisions (which columns survive pruning) are made from one aggregate
row -- one value per column, bounded by the schema width -- the only thing
that reaches the driver.  Per-split statistics are grouped aggregates joined
back by broadcast (one row per split), never a window over a whole split.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_affixes(df: DataFrame, prefix: str = "", suffix: str = "", key: str = "object_id") -> DataFrame:
    """``<prefix><col><suffix>`` on every column except the key."""
    if not prefix and not suffix:
        return df
    return df.withColumnsRenamed({c: f"{prefix}{c}{suffix}" for c in df.columns if c != key})


def assemble_features(ids: DataFrame, parts: list[tuple[DataFrame, str, str]], key: str = "object_id") -> DataFrame:
    """Left-join feature sets onto the object ids by key (never by position).

    Every part is an aggregate keyed by ``key``, i.e. already hash-partitioned
    on it, so the joins are co-partitioned merges."""
    out = ids.select(key)
    for df, prefix, suffix in parts:
        out = out.join(with_affixes(df, prefix, suffix, key), key, "left")
    return out


def domain_column(meta: DataFrame) -> F.Column:
    """``gal`` iff hostgal_photoz == 0 else ``exgal``."""
    return F.when(F.col("hostgal_photoz") == 0, F.lit("gal")).otherwise(F.lit("exgal"))


def redshift_outliers(meta: DataFrame, limit: float = 0.1) -> DataFrame:
    """P20: objects whose spectroscopic and photometric redshifts differ by more than ``limit`` (both known)."""
    gap = F.abs(F.col("hostgal_specz") - F.col("hostgal_photoz"))
    return meta.withColumn("z_gap", gap).filter(F.col("z_gap") > limit)


def one_hot(df: DataFrame, label: str, classes: list[int], prefix: str = "is_") -> DataFrame:
    """One 0/1 column per class (sorted); an unknown or NULL label is 0 everywhere."""
    return df.withColumns({f"{prefix}{c}": F.coalesce((F.col(label) == c).cast("int"), F.lit(0)) for c in sorted(classes)})


def column_report(df: DataFrame, key: str = "object_id") -> DataFrame:
    """P10 / P11 input: per column, non-NULL count and population std (NULLs ignored),
    as a long table (one row per column) computed in one pass."""
    cols = [c for c in df.columns if c != key]
    agg = df.agg(*[F.struct(F.count(c).alias("n"), F.stddev_pop(F.col(c).cast("double")).alias("s")).alias(c)
                   for c in cols])
    long = agg.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c)["n"].alias("n_nonnull"),
                                                  F.col(c)["s"].alias("std")) for c in cols])))
    return long.withColumn("keep", (F.col("n_nonnull") > 0) & (F.col("std") != 0))


def prune_columns(train: DataFrame, *others: DataFrame, key: str = "object_id") -> list[DataFrame]:
    """P10 + P11 + P12: drop all-NULL and zero-variance columns of ``train``; the
    other splits are aligned to train's surviving columns."""
    keep = [r["column"] for r in column_report(train, key).filter("keep").select("column").collect()]
    cols = [key] + [c for c in train.columns if c in set(keep)]
    return [train.select(*cols)] + [o.select(*cols) for o in others]


def fill_and_flag(df: DataFrame, cols: list[str], split: str | None = None) -> DataFrame:
    """P14 + P15: ``missing_flg_<col>`` indicators, then NULLs filled with the
    column mean of the row's own split (one grouped aggregate per split)."""
    flags = {f"missing_flg_{c}": F.col(c).isNull().cast("int") for c in cols}
    out = df.withColumns(flags)
    if split is None:
        means = df.agg(F.struct(*[F.avg(c).alias(c) for c in cols])).scalar()
        return out.withColumns({c: F.coalesce(F.col(c), means[c]) for c in cols})
    m = df.groupBy(split).agg(*[F.avg(c).alias(f"_mean_{c}") for c in cols])
    out = out.join(F.broadcast(m), split, "left")  # one row per split
    out = out.withColumns({c: F.coalesce(F.col(c), F.col(f"_mean_{c}")) for c in cols})
    return out.drop(*[f"_mean_{c}" for c in cols])


def fill_constant(df: DataFrame, cols: list[str], value: float = 0.0) -> DataFrame:
    """P13."""
    return df.na.fill(value, subset=cols)


def standard_scale(df: DataFrame, cols: list[str]) -> DataFrame:
    """(x - mean) / population std over all rows (one scalar-subquery row of stats)."""
    st = df.agg(F.struct(*[F.avg(c).alias(f"{c}_m") for c in cols],
                         *[F.stddev_pop(c).alias(f"{c}_s") for c in cols])).scalar()
    return df.withColumns({c: F.try_divide(F.col(c) - st[f"{c}_m"], st[f"{c}_s"]) for c in cols})


def sample_objects(ids: DataFrame, n: int, seed: int = 71, key: str = "object_id") -> DataFrame:
    """``n`` objects without replacement in seeded hash order (a top-n, bounded by n)."""
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    return ids.select(key, h.alias("_h")).orderBy("_h").limit(n).select(key)


def sample_observations(lc: DataFrame, ids: DataFrame, n: int, seed: int = 71) -> DataFrame:
    """O7 + P6: observations of the sampled objects (semi join)."""
    return lc.join(sample_objects(ids, n, seed), "object_id", "left_semi")


def stack_splits(train: DataFrame, test: DataFrame) -> DataFrame:
    """Train and test stacked with a ``split`` literal column (split back by filter)."""
    return train.withColumn("split", F.lit("train")).unionByName(
        test.withColumn("split", F.lit("test")), allowMissingColumns=True)


def union_all(dfs: list[DataFrame]) -> DataFrame:
    """U1."""
    return reduce(lambda a, b: a.unionByName(b), dfs)


def head_per_group(df: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """First ``n`` rows of every group (a per-group top-n: the limit is the feature).
    ``row_number() <= n`` lets Spark insert a window group limit below the
    shuffle, so a large group ships only n rows per map task."""
    from pyspark.sql import Window
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def row_audit(lc: DataFrame, meta: DataFrame) -> DataFrame:
    """W3 / S4 check: rows, objects, objects only in lc or only in meta -- one row,
    from one full outer join of per-object counts (both keyed by object_id)."""
    per = lc.groupBy("object_id").agg(F.count(F.lit(1)).alias("n"))
    j = per.join(meta.select("object_id", F.lit(1).alias("_m")), "object_id", "full_outer")
    return j.agg(F.sum("n").alias("n_rows"), F.count("n").alias("n_objects_lc"),
                 F.count("_m").alias("n_objects_meta"),
                 F.count(F.when(F.col("_m").isNull(), 1)).alias("only_in_lc"),
                 F.count(F.when(F.col("n").isNull(), 1)).alias("only_in_meta"),
                 F.countDistinct("object_id").alias("n_objects_total"))


#: rows of a file that are looked at together
ORDER_CHUNK = 1_000_000


def with_file_order(df: DataFrame) -> DataFrame:
    """Rows of a file scan with their place: ``_file`` and ``_row``."""
    return df.withColumns({"_file": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")})


def order_audit(rows: DataFrame, key: str = "object_id", time: str = "mjd") -> DataFrame:
    """The order of the stored rows (with ``_file`` and ``_row``, files by path) -- one row: n_rows, n_keys, n_runs
    (stretches of one key; as many as keys if every key is contiguous), key_descents, time_descents (within a stretch).

    Differences are taken within chunks of a file; a chunk's first row meets the last row of the chunk before it, and a
    file's first chunk the last one of the file before, so no task sees more than a chunk of rows, a file's chunks or the files."""
    from pyspark.sql import Window

    rows = rows.select("_file", "_row", F.floor(F.col("_row") / ORDER_CHUNK).alias("_chunk"), F.struct(F.col(key).alias("k"), F.col(time).alias("t")).alias("own"))
    here = Window.partitionBy("_file", "_chunk").orderBy("_row")
    inner = rows.select("own", F.lag("own").over(here).alias("prev"), (F.row_number().over(here) == 1).alias("first"))
    ends = rows.groupBy("_file", "_chunk").agg(F.min_by("own", "_row").alias("first"), F.max_by("own", "_row").alias("last"))
    in_file = Window.partitionBy("_file").orderBy("_chunk")
    ends = ends.withColumns({"before": F.lag("last").over(in_file), "head": F.row_number().over(in_file) == 1})
    files = ends.groupBy("_file").agg(F.min_by("first", "_chunk").alias("first"), F.max_by("last", "_chunk").alias("last"))
    over_files = Window.orderBy("_file")   # one row a file
    seams = ends.filter("NOT head").select(F.col("first").alias("own"), F.col("before").alias("prev"), F.lit(False).alias("start")).unionByName(
        files.select(F.col("first").alias("own"), F.lag("last").over(over_files).alias("prev"), (F.row_number().over(over_files) == 1).alias("start")))
    steps = inner.filter("NOT first").select("own", "prev", F.lit(False).alias("start")).unionByName(seams)
    same = "own.k <=> prev.k"
    out = steps.agg(F.count(F.lit(1)).alias("n_rows"), F.expr(f"count_if(start OR NOT ({same})) AS n_runs"),
                    F.expr("count_if(NOT start AND own.k < prev.k) AS key_descents"), F.expr(f"count_if(NOT start AND {same} AND own.t < prev.t) AS time_descents"))
    keys = rows.agg(F.countDistinct("own.k")).scalar()
    return out.select("n_rows", keys.alias("n_keys"), "n_runs", "key_descents", "time_descents")
