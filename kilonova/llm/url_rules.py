"""Operator 7: URL rules by a sort-merge range join.

A host is written with its labels reversed and a closing dot (``www.example.org`` -> ``org.example.www.``), so a rule
host covers exactly one interval of canonical keys: all keys that begin with its own.  URLs are dealt to ranges of
(key, hash of the row); a rule goes to every range that its interval meets.  Within a range both sides are sorted and
swept once: a stack holds the rules whose interval contains the current key (intervals nest, so rules leave the stack in
reverse order), and the path decides among them.  A hot host spreads over several ranges, as the ranges also cut by row
hash.  Bounds of ranges come from a sample of bounded size and only steer the balance; every row is judged.

Longest rule: the most characters of host and path together, then the longer host, then the smaller host and path.
Null urls and urls without ``://`` have an empty host and path, and no rule.  Repeated rows are judged each for itself;
repeated rules count once; among equal rules with both verdicts, block wins.  No rule: ``default`` verdict.
"""
from __future__ import annotations

from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: the production rules (fixed values): verdict, host, path
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

_SAMPLE_PER_RANGE = 24


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def split_url(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` and ``path`` to rows (struct ``row`` keeps every column of ``pages``)."""
    rest = F.expr("case when instr(u, '://') > 0 then substring(u, instr(u, '://') + 3) else '' end")
    ascii_lower = F.translate(F.regexp_extract("rest", r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return (pages.select(F.struct(*[pages[c] for c in pages.columns]).alias("row"), pages[url].alias("u"))
            .select("row", F.coalesce(rest, F.lit("")).alias("rest"))
            .select("row", ascii_lower.alias("host"), F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path")))


def host_key(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "." if host else ""


def _after(prefix: str) -> tuple[str]:
    """A key behind all keys that begin with ``prefix``."""
    return (prefix + "\U0010ffff" * 2,)


def _to_ranges(bounds: list[tuple[str, int]]):
    def deal(batches):
        for b in batches:
            hosts, hs = b.column("host").to_pylist(), b.column("h").to_pylist()
            keys = [host_key(x) for x in hosts]
            at = [bisect_right(bounds, (k, h)) for k, h in zip(keys, hs)]
            n = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int32()), pa.array(keys, pa.string()), pa.array([1] * n, pa.int32()), b.column("row"),
                 b.column("host"), b.column("path"), pa.nulls(n, pa.string())],
                names=["range", "key", "kind", "row", "host", "path", "verdict"])
    return deal


def _rules_to_ranges(bounds: list[tuple[str, int]], row_type: pa.DataType):
    def deal(batches):
        for b in batches:
            out = []
            for v, h, p in zip(*(b.column(c).to_pylist() for c in ("verdict", "host", "path"))):
                k = host_key(h)
                first, last = bisect_left(bounds, (k,)), bisect_left(bounds, _after(k))
                out += [(r, k, h, p, v) for r in range(first, last + 1)]
            r, k, h, p, v = map(list, zip(*out)) if out else ([],) * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(r, pa.int32()), pa.array(k, pa.string()), pa.array([0] * len(r), pa.int32()), pa.nulls(len(r), row_type),
                 pa.array(h, pa.string()), pa.array(p, pa.string()), pa.array(v, pa.string())],
                names=["range", "key", "kind", "row", "host", "path", "verdict"])
    return deal


def _best(stack, path: str):
    best = None
    for k, rules in stack:
        for host, prefix, verdict in rules:
            if path.startswith(prefix):
                rank = (-len(host) - len(prefix), -len(host), host, prefix, verdict != "block")
                if best is None or rank < best[0]:
                    best = (rank, host + prefix, verdict)
    return best


def _sweep(default: str):
    def sweep(batches):
        here, stack, seen = None, [], {}
        for b in batches:
            ranges, keys, kinds = (b.column(c).to_pylist() for c in ("range", "key", "kind"))
            hosts, paths, verdicts = (b.column(c).to_pylist() for c in ("host", "path", "verdict"))
            keep, rule, said = [], [], []
            for i, (r, k, kind) in enumerate(zip(ranges, keys, kinds)):
                if r != here:
                    here, stack, seen = r, [], {}
                while stack and not k.startswith(stack[-1][0]):
                    stack.pop()
                    seen = {}
                if kind == 0:
                    if not stack or stack[-1][0] != k:
                        stack.append((k, []))
                    stack[-1][1].append((hosts[i], paths[i], verdicts[i]))
                    seen = {}
                else:
                    best = _best(stack, paths[i]) if k and stack else None
                    keep.append(i)
                    rule.append(best and best[1])
                    said.append(best[2] if best else default)
            got = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([got.column("row"), got.column("host"), got.column("path"), pa.array(rule, pa.string()),
                                              pa.array(said, pa.string())], names=["row", "host", "path", "rule", "verdict"])
    return sweep


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", ranges: int | None = None) -> DataFrame:
    """One row per row of ``pages``: ``row`` (all its columns), host, path, rule (host and path of the longest rule that
    fits, or null), verdict.  ``rules``: verdict, host, path."""
    spark = pages.sparkSession
    from pyspark.sql.pandas.types import to_arrow_type

    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    urls = split_url(pages, url).withColumn("h", F.xxhash64("row"))
    want = min(ranges * _SAMPLE_PER_RANGE, 100_000)
    share = min(1.0, want / max(1, pages.count()))
    sample = urls.select("host", "h").where(F.pmod(F.xxhash64("h", F.lit(7)), F.lit(1 << 24)) < int(share * (1 << 24)) + 1)
    sample = sample.limit(2 * want).collect()
    keys = sorted((host_key(x.host), x.h) for x in sample)
    bounds = [keys[len(keys) * i // ranges] for i in range(1, ranges)] if keys else []
    bounds = sorted(set(bounds))
    row = urls.schema["row"].dataType
    schema = f"range int, key string, kind int, row {row.simpleString()}, host string, path string, verdict string"
    dealt = urls.mapInArrow(_to_ranges(bounds), schema)
    rules = rules.select("verdict", F.lower("host").alias("host"), F.coalesce("path", F.lit("")).alias("path")).where("host <> ''")
    both = dealt.unionByName(rules.distinct().mapInArrow(_rules_to_ranges(bounds, to_arrow_type(row)), schema))
    swept = both.repartition(ranges, "range").sortWithinPartitions("range", "key", "kind")
    return swept.mapInArrow(_sweep(default), f"row {row.simpleString()}, host string, path string, rule string, verdict string")
