"""Readers and writers.

Declared schemas instead of inference; NaN normalised to NULL at the scan
(D9); parquet as the feature store; every intermediate that is re-read goes to
the shared ``spark.checkpoint.dir`` (or a caller-given shared path), never a
machine-local folder.
"""
from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import nan_to_null
from ..session import ensure_checkpoint_dir
from .schemas import LC_SCHEMA, META_SCHEMA


def _normalise(df: DataFrame) -> DataFrame:
    return df.select(*[nan_to_null(c).alias(c) if t in ("double", "float") else F.col(c)
                       for c, t in df.dtypes])


def read_lc(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """S3: observation table with the declared schema, NaN -> NULL."""
    r = spark.read.schema(LC_SCHEMA)
    df = r.csv(path, header=True) if fmt == "csv" else r.format(fmt).load(path)
    return _normalise(df)


def read_meta(spark: SparkSession, path: str, fmt: str = "csv", with_target: bool = True) -> DataFrame:
    """Metadata table (test files have no target column)."""
    schema = META_SCHEMA if with_target else T.StructType([f for f in META_SCHEMA.fields if f.name != "target"])
    r = spark.read.schema(schema)
    df = r.csv(path, header=True) if fmt == "csv" else r.format(fmt).load(path)
    return _normalise(df)


def resolve(config: dict, data_type: str, split: str) -> str:
    """Path lookup from a config document (``config['dataset'][data_type][split]``)."""
    return config["dataset"][data_type][split]


def read_config(spark: SparkSession, path: str) -> dict:
    """A JSON config / prior result document (small, read whole by the driver)."""
    row = spark.read.text(path, wholetext=True).first()
    return json.loads(row[0])


def prior_features(document: dict, key: str = "features", importance: str = "importance") -> list[str]:
    """The feature names of an earlier run: its list, or else the names of its importance table."""
    return list(document[key]) if key in document else list(document.get(importance, {}))


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def write_features(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Parquet feature store (``mode='append'`` for chunked producers)."""
    df.write.mode(mode).parquet(path)
    return path


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """S5."""
    return spark.read.parquet(path)


def write_predictions_csv(pred: DataFrame, path: str, digits: int = 6) -> str:
    """Prediction table as CSV with a header, doubles as fixed decimals of ``digits`` digits (0.000001, not 1.0E-6)."""
    fixed = lambda c: F.when(F.col(c).isNotNull(), F.format_string(f"%.{digits}f", F.col(c)))
    out = pred.select(*[fixed(c).alias(c) if t == "double" else F.col(c) for c, t in pred.dtypes])
    out.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_result_json(spark: SparkSession, result: DataFrame, path: str) -> str:
    """A (one-row) result DataFrame as a JSON document."""
    result.select(F.to_json(F.struct(*result.columns)).alias("value")).coalesce(1) \
          .write.mode("overwrite").text(path)
    return path


def write_sequences(seq: DataFrame, path: str) -> str:
    """Padded sequences, one folder per band."""
    seq.write.mode("overwrite").partitionBy("passband").parquet(path)
    return path


def read_sequences(spark: SparkSession, path: str, band: int | None = None) -> DataFrame:
    """S6 (partition pruning on the band folder)."""
    df = spark.read.parquet(path)
    return df if band is None else df.filter(F.col("passband") == band)
