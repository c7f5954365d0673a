"""Operator 10: secret scans with corpus-wide ownership frequency.

Each text is scanned once for spans of three base kinds and for *candidates* of a fourth kind (long mixed tokens of
high entropy that no base span covers).  The digest of every found secret is counted over the whole corpus by distinct
repositories (a text of an owner; its copies there are one) and distinct owners: a value that many owners carry is a copied
example, a value that stays with one or two owners is a live-looking credential, in however many of their repositories it
stands.  Both figures are reported.  Base spans always stay; a candidate becomes a span (kind ``owned``) only when its
ownership is that narrow.  Only digests are shuffled, never the values.

Null, empty and white-space texts have no spans; a null owner, or a table without owners, counts as one unnamed owner.
Repeated rows are scanned each for itself.  Output order of spans: by start, then kind in the order of ``KINDS``.
"""
from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column_of, written

KINDS = ("assign", "access", "hex", "owned")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # maximal runs: the same matches as [0-9a-f]+ without the short ones
MIXED = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

#: production parameters: a value with at most this many distinct owners is owner-specific
MAX_OWNERS = 2
MIN_ENTROPY = 3.5  # bits a character


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def find(text: str | None) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of every base span and candidate of a text, in order.  Code points, end exclusive."""
    if not text:
        return []
    out = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    base = sorted((s, e) for s, _, e, _ in out)
    k, reach = 0, 0
    for m in MIXED.finditer(text):
        v = m[0]
        while k < len(base) and base[k][0] < m.end():
            reach = max(reach, base[k][1])
            k += 1
        if reach <= m.start() and re.search("[0-9]", v) and re.search("[A-Za-z]", v) and _entropy(v) >= MIN_ENTROPY:
            out.append((m.start(), 3, m.end(), v))
    return sorted(out)


_FOUND = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("digest", pa.binary())]))
_FOUND_SQL = "array<struct<start:long,kind:int,end:long,digest:binary>>"


def _digest(v: str) -> bytes:
    return hashlib.sha256(v.encode("utf-8", "surrogatepass")).digest()[:16]


def _scan(batches, text: str = "text"):
    for b in batches:
        rows, repos = [], []
        for t in column_of(b, text).to_pylist():
            got = find(t)
            rows.append([{"start": s, "kind": k, "end": e, "digest": _digest(v)} for s, k, e, v in got])
            repos.append(_digest(t) if got else None)
        keep = [i for i, n in enumerate(b.schema.names) if n != "text"]
        yield pa.RecordBatch.from_arrays([*(b.columns[i] for i in keep), pa.array(rows, _FOUND), pa.array(repos, pa.binary())],
                                         names=[*(b.schema.names[i] for i in keep), "found", "repo"])


def _joined(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def ownership(scanned: DataFrame) -> DataFrame:
    """digest, n_repos, n_owners of every value found in rows with owner, repo and found."""
    hits = scanned.where(F.size("found") > 0).select("owner", "repo", F.explode("found.digest").alias("digest"))
    # one row per (value, owner, repository), then per (value, owner): copies and repetitions go on the map side
    one = hits.groupBy("digest", "owner", "repo").agg(F.lit(1).alias("one"))
    return one.groupBy("digest", "owner").agg(F.count("*").alias("n")).groupBy("digest").agg(
        F.sum("n").alias("n_repos"), F.count("*").alias("n_owners"))


def _judged(rows: DataFrame, owned: DataFrame, max_owners: int) -> DataFrame:
    """Per ``rid`` of rows with found values: spans (base ones and live candidates), n_live, n_shared, most_repos, most_owners.
    A value that a third of all rows hold makes a skewed join, which Spark splits."""
    hits = rows.where(F.size("found") > 0).select("rid", F.explode("found").alias("s")).withColumn("digest", F.col("s.digest"))
    judged = hits.join(owned, "digest").withColumn("live", F.col("n_owners") <= max_owners)
    return judged.groupBy("rid").agg(
        F.array_sort(F.collect_list(F.when(F.col("live") | (F.col("s.kind") < 3),
                                           F.struct("s.start", "s.kind", "s.end")))).alias("spans"),
        F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_shared"),
        F.max("n_repos").alias("most_repos"), F.max("n_owners").alias("most_owners"))


def _owner(docs: DataFrame, owner: str) -> Column:
    return docs[owner].cast("string") if owner in docs.columns else F.lit(None).cast("string")


def secret_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source",
                 max_owners: int = MAX_OWNERS) -> DataFrame:
    """One row per row of ``docs``: ``key``, spans (array of start, kind, end; final), n_live, n_shared (found values,
    base ones included, that are owner-specific or widely copied), most_repos, most_owners (largest numbers of repositories
    and owners of one of its values; 0: no value)."""
    src = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("key"),
                      _owner(docs, owner).alias("owner"), F.col(text).alias("text"))
    scanned = src.mapInArrow(
        _scan, "rid long, key " + docs.schema[key].dataType.simpleString() + f", owner string, found {_FOUND_SQL}, repo binary")
    scanned = written(scanned, "secret-scan")
    per_row = _judged(scanned, ownership(scanned), max_owners)
    none = F.array().cast("array<struct<start:long,kind:int,end:long>>")
    return (scanned.select("rid", "key").join(per_row, "rid", "left")
            .select(F.col("key").alias(key), F.coalesce("spans", none).alias("spans"),
                    *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_live", "n_shared", "most_repos", "most_owners")]))


def secret_report(docs: DataFrame, **params) -> DataFrame:
    """The digest form: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_shared, most_repos, most_owners."""
    s = secret_spans(docs, **params)
    n = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("spans", lambda x: x["kind"] < 3)
    return s.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
                    F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
                    "n_live", "n_shared", "most_repos", "most_owners")


def _mask(batches):
    for b in batches:
        texts, spans = b.column("_text").to_pylist(), b.column("_spans").to_pylist()
        out = []
        for t, ss in zip(texts, spans):
            if t and ss:
                parts, at = [], 0
                for s in ss:
                    if s["end"] <= at:
                        continue
                    if s["start"] >= at:
                        parts += [t[at:s["start"]], "[SECRET]"]
                    at = s["end"]
                t = "".join([*parts, t[at:]])
            out.append(t)
        cols = [c for c, f in zip(b.columns, b.schema) if f.name not in ("_text", "_spans")]
        names = [f.name for f in b.schema if f.name not in ("_text", "_spans")]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(out, pa.string())], names=[*names, "_masked"])


def mask_secrets(docs: DataFrame, text: str = "text", owner: str = "source", max_owners: int = MAX_OWNERS) -> DataFrame:
    """``docs`` with every span replaced by ``[SECRET]`` (overlapping spans become one); all other columns and rows
    stay.  A column ``n_chars`` is kept equal to the new text's length.

    One scan writes the rows with what it found.  Rows without candidates need no verdict and aren't shuffled: their base
    spans are masked, or they pass as they are.  Only rows with candidates meet the ownership counts."""
    src = docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*[docs[c] for c in docs.columns]).alias("row"),
                      _owner(docs, owner).alias("owner"))
    row = f"row {src.schema['row'].dataType.simpleString()}"
    scanned = src.mapInArrow(lambda batches: _scan(batches, text), f"rid long, {row}, owner string, found {_FOUND_SQL}, repo binary")
    scanned = written(scanned, "secret-rows")
    open_ = F.exists("found", lambda s: s["kind"] == 3)
    judged = _judged(scanned.where(open_).select("rid", "found"), ownership(scanned), max_owners)
    plain = scanned.where(F.size("found") == 0).select("row.*")
    base = F.transform("found", lambda s: F.struct(s["start"], s["kind"], s["end"]))
    todo = scanned.where((F.size("found") > 0) & ~open_).select("row", F.col(f"row.{text}").alias("_text"), base.alias("_spans"))
    todo = todo.unionByName(scanned.where(open_).select("rid", "row").join(judged.select("rid", F.col("spans").alias("_spans")), "rid")
                            .select("row", F.col(f"row.{text}").alias("_text"), "_spans"))
    done = todo.mapInArrow(_mask, f"{row}, _masked string")
    new = {text: F.col("_masked")}
    if "n_chars" in docs.columns and "n_chars" != text:
        new["n_chars"] = F.char_length("_masked").cast(docs.schema["n_chars"].dataType)
    done = done.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
    return plain.unionByName(done)
