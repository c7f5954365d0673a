"""Cleaning pipeline over ``documents``: toxicity, quality rules, near-dedup, secret scan, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``.  All stages but the last return the columns of ``documents``: the first three drop rows (toxic texts,
texts that fail the quality rules, all but one of each group of near duplicates), the fourth masks secrets in ``text``
(and keeps ``n_chars`` true); the last returns one row per packed piece.  Rows, columns and names beyond those of
``documents`` pass through; null and empty texts are judged like the operators say (an empty text fails the quality
rules).  Every stage works on whole texts and on all that its predecessor kept.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kilonova.llm import near_dup, packing, quality_rules, secret_scan, toxicity
from kilonova.llm.common import table, written

#: several stages are learned models and iterative joins; SQL can't express them
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, fitted on ``labels.toxic``, scores below one half."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score_texts(docs, model, keep_text=True).where("score < 0.5").select("row.*")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rule and the decision list learned from ``labels.quality``."""
    rows, _ = quality_rules.quality_rules(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"), keep_text=True)
    return rows.where("kept").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates."""
    return near_dup.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets in their texts replaced."""
    return secret_scan.mask_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every text in a bin of a permitted length."""
    return packing.pack_texts(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", keep_quality),
    ("near_dedup", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
