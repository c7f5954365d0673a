"""Operator 11: filter interaction audit by the Hart-Mas-Colell potential.

Five filters judge every whole text; a document that fails the filters of a set S is removed by any order that applies
them.  The removal game v(S) = documents that fail a filter of S is known for all 32 coalitions from the counts of
documents per failure mask, which is all that leaves Spark's aggregation (at most 32 rows a part).  Then

* the potential P(S) = (v(S) + sum of P(S without i)) / |S|, P(no filter) = 0, by rising size of S,
* a filter's Shapley value is P(all) - P(all without it), its mean of removals over all orders,
* a step of an order is a coalition difference: removed = v(S with i) - v(S), and the same for labelled documents.

All in whole numbers: P times lcm(1..n) is one.

A null text counts as empty.  A null part is the empty string.  Duplicates are judged over the whole table by digest
(SHA-256, 128 bits): a document fails if a smaller id has the same text; a null id is neither smaller nor larger than
any id, so it never fails, and it has no labels.  Repeated rows count each; of rows with one id and one text none is
smaller.  A document with several labels is good (toxic) if one of them says so.  An empty table has no part and no
row.  Other columns, whatever their names, are not read.
"""
from __future__ import annotations

import math
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, written

#: production parameters: the filters in the order of their bits
FILTERS = "ABCDE"


def conditions(text: Column, words: Column) -> list[Column]:
    """Whether a text fails A (short), B (repetitive), C (shouting), D (symbols)."""
    n = F.size(words)
    return [n < 200,
            100 * F.size(F.array_distinct(words)) < 50 * n,
            100 * F.char_length(F.regexp_replace(text, "[^A-Z]+", "")) > 3 * F.char_length(text),
            text.rlike("[#$%&*|]")]


def failure_masks(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang",
                  good: str = "quality", toxic: str = "toxic") -> DataFrame:
    """part, mask (bit k: filter k fails), n, n_good, n_toxic: the counts of documents."""
    src = docs.select(F.col(key).alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                      F.coalesce(F.col(text), F.lit("")).alias("text"))
    words = F.array_remove(F.split(F.translate("text", SPACES, " " * len(SPACES)), " "), "")
    cut = src.select("key", "part", "text", words.alias("words"))
    bits = conditions(F.col("text"), F.col("words"))
    own = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(bits)), F.lit(0))
    # one scan of the texts; rows that repeat collapse on the map side
    rows = cut.select("key", "part", own.alias("mask"), F.unhex(F.substring(F.sha2("text", 256), 1, 32)).alias("digest"))
    rows = written(rows.groupBy("key", "digest", "part", "mask").agg(F.count("*").alias("n")), "audit-rows")
    known = rows.where("key is not null")
    # a first copy is found by (digest, key), so a text that a third of all rows repeat is dealt by its keys
    first = known.groupBy("digest").agg(F.min("key").alias("key")).withColumn("first", F.lit(True))
    marks = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(
        F.max((F.col(good) == 1).cast("int")).alias("good"), F.max((F.col(toxic) == 1).cast("int")).alias("toxic"))
    judged = known.join(first, ["digest", "key"], "left").join(marks, "key", "left").select(
        "part", (F.col("mask") + F.when(F.col("first"), 0).otherwise(1 << len(bits))).alias("mask"), "n",
        (F.col("n") * F.coalesce("good", F.lit(0))).alias("g"), (F.col("n") * F.coalesce("toxic", F.lit(0))).alias("t"))
    none = F.lit(0).cast("long")
    loose = rows.where("key is null").select("part", "mask", "n", none.alias("g"), none.alias("t"))
    return judged.unionByName(loose).groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum("g").alias("n_good"), F.sum("t").alias("n_toxic"))


def coalition_values(counts: dict[int, int], n: int) -> list[int]:
    """v(S) for every coalition S of n filters: documents whose mask meets S."""
    inside = [counts.get(s, 0) for s in range(1 << n)]
    for k in range(n):  # inside[s] becomes the documents whose mask lies within s
        for s in range(1 << n):
            if s >> k & 1:
                inside[s] += inside[s ^ 1 << k]
    return [inside[-1] - inside[~s & (1 << n) - 1] for s in range(1 << n)]


def potentials(v: list[int], n: int) -> list[int]:
    """lcm(1..n) times the Hart-Mas-Colell potential of every coalition; whole numbers."""
    scale = math.lcm(*range(1, n + 1))
    p = [0] * (1 << n)
    for s in sorted(range(1, 1 << n), key=int.bit_count):
        p[s] = (scale * v[s] + sum(p[s ^ 1 << k] for k in range(n) if s >> k & 1)) // s.bit_count()
    return p


def order_sums(v: list[int], n: int) -> list[int]:
    """n! times each filter's Shapley value: its removals summed over all orders."""
    p, full = potentials(v, n), (1 << n) - 1
    times = math.factorial(n) // math.lcm(*range(1, n + 1))
    return [times * (p[full] - p[full ^ 1 << k]) for k in range(n)]


_OUT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
        "good_lost long, toxic_lost long, shapley long")


def _steps(names: str):
    n = len(names)
    full = (1 << n) - 1

    def rows_of(part: str, cells: list[dict]):
        v, good, toxic = (coalition_values({c["mask"]: c[k] for c in cells}, n) for k in ("n", "n_good", "n_toxic"))
        total, sums = sum(c["n"] for c in cells), order_sums(v, n)
        for order in permutations(range(n)):
            s = 0
            for step, k in enumerate(order, 1):
                then = s | 1 << k
                removed = v[then] - v[s]
                yield {"part": part, "filter_order": "".join(names[i] for i in order), "step": step, "kept": total - v[then],
                       "removed": removed, "redundant": v[1 << k] - removed, "unique_fails": v[full] - v[full ^ 1 << k],
                       "good_lost": good[then] - good[s], "toxic_lost": toxic[then] - toxic[s], "shapley": sums[k]}
                s = then

    def steps(batches):
        for b in batches:
            for part, cells in zip(b.column("part").to_pylist(), b.column("cells").to_pylist()):
                yield pa.RecordBatch.from_pylist(list(rows_of(part, cells)), _SCHEMA)
    return steps


_SCHEMA = pa.schema([(f.split()[0], {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[f.split()[1]]) for f in _OUT.split(", ")])


def audit(masks: DataFrame, names: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step, from ``failure_masks``."""
    parts = masks.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "n_good", "n_toxic")).alias("cells"))
    return parts.mapInArrow(_steps(names), _OUT)


def filter_audit(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    return audit(failure_masks(docs, labels, **columns))
