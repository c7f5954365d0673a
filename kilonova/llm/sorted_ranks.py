"""Exact global ranks by parallel sorting by regular sampling.

Each input partition is sorted for itself (a run).  Every w-th row of each run is a sample; the sorted samples give
regular splitters, so a segment between two splitters holds at most n / p + runs * w rows whatever the runs look like.
Rows move to the task of their segment, which merges what it gets, and the counts of the segments before it turn places
into ranks.  Order: the key columns ascending, then run and place, so equal keys (a third of all rows, say) are parted
like any others.  Key columns hold no nulls (callers map them).
"""
from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: production parameters: rows of a segment, samples that reach the driver (beside less than one a run)
SEGMENT = 1_000_000
SAMPLES = 200_000
_SMALL = 5_000  # rows of a segment in small tables


def sorted_runs(rows: DataFrame, keys: list[str], what: str) -> DataFrame:
    """``rows`` written as locally sorted runs, with ``_at`` = run << 33 | place."""
    return written(rows.sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), f"{what}-runs")


def _key(cols: list[pa.Array], i: int) -> tuple:
    return tuple(c[i].as_py() for c in cols)


def _segments(keys: list[str], splitters: list[tuple]):
    """Adds ``_segment``, the number of splitters up to a row's key."""
    def segments(batches):
        for b in batches:
            cols, at, n = [b.column(k) for k in keys], b.column("_at").to_numpy(), b.num_rows
            seg = np.zeros(n, np.int32)
            # stretches of one run, sorted by the way they were written
            ends = [*(np.flatnonzero(np.diff(at) != 1) + 1).tolist(), n] if n else []
            lo = 0
            for hi in ends:
                while lo < hi:
                    s = bisect_right(splitters, _key(cols, lo))
                    upto = hi
                    if s < len(splitters) and _key(cols, hi - 1) >= splitters[s]:
                        low = lo
                        while low < upto:  # first row at or beyond the next splitter
                            mid = (low + upto) // 2
                            if _key(cols, mid) < splitters[s]:
                                low = mid + 1
                            else:
                                upto = mid
                    seg[lo:upto] = s
                    lo = upto
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(seg)], names=[*b.schema.names, "_segment"])
    return segments


def ranked(runs: DataFrame, keys: list[str], what: str) -> DataFrame:
    """The rows of ``sorted_runs`` with their exact ``rank`` (long, from 1) instead of ``_at``."""
    spark, order = runs.sparkSession, [*keys, "_at"]
    n = runs.count()
    p = max(-(-n // SEGMENT), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // _SMALL)), 1)
    n_runs = runs.select(F.shiftright("_at", 33)).distinct().count()
    step = max(1, n // max(1, min(SAMPLES, n_runs * p)))
    place = F.col("_at").bitwiseAND((1 << 33) - 1)
    picked = runs.where(F.pmod(place, F.lit(step)) == step // 2).select(*order).collect()
    samples = sorted(tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in picked)
    splitters = [samples[len(samples) * k // p] for k in range(1, p)] if samples else []
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in runs.schema)
    dealt = runs.mapInArrow(_segments(order, splitters), f"{names}, _segment int")
    merged = dealt.repartitionById(p, F.col("_segment")).sortWithinPartitions("_segment", *order)
    merged = written(merged.withColumn("_pos", F.monotonically_increasing_id()), f"{what}-merged")
    before, ahead = 0, []
    for r in sorted(merged.groupBy("_segment").agg(F.min("_pos").alias("first"), F.count("*").alias("n")).collect()):
        ahead.append((r["_segment"], before - r["first"] + 1))
        before += r["n"]
    ahead = spark.createDataFrame(ahead, "_segment int, _ahead long")
    joined = merged.join(F.broadcast(ahead), "_segment")  # one row a segment
    return joined.select(*[c for c in runs.columns if c != "_at"], (F.col("_pos") + F.col("_ahead")).alias("rank"))
