"""Slices of a value's range that bound what one task gets of a huge key.

Windows and exact quantiles need the rows of a key in order.  Instead of one
task per key, work is done per (key, slice): the slices cut the range of the
ordering column at approximate quantiles of the *whole* table, so that a slice
holds about ``SLICE_ROWS`` rows of all keys together and no key can hold more
than that in one place.  Every key is cut by the same points (no hot-key list,
no per-key threshold); a table below ``SLICE_ROWS`` rows is one slice.

The number of slices follows the number of rows without a limit; the cut points
are one row of numbers (8 bytes a slice).

Many small keys need no slices, however long the table: where no key has more
rows than a task may hold (``whole_keys``, measured), keys stay whole.  The
adapters measure it once and leave it in the metadata of ``object_id``
(``sized``), so the steps of a query don't run their input to count it again.
Chains of steps on tables of large keys start at a stored table that is counted
once (``measured``) and store what the next steps read (``stored``).
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_ROWS = 4_000_000
SLICE_ROWS_CONF = "kilonova.sliceRows"
#: bytes of a stored row at least; tables whose files hold less than a slice's worth aren't counted
LEAST_ROW_BYTES = 4
#: rows of a key that a task may hold at once, as a map of its values
KEY_ROWS = 20_000
MOST_ROWS = "kilonova.mostRows"
#: metadata of a key of a table that ``measured`` counted: its rows at most, and either that its keys are cut without asking
#: again, or the keys that were counted (their largest has ``MOST_OF`` rows)
ROWS, CUT, COUNTED, MOST_OF = "kilonova.rows", "kilonova.cut", "kilonova.counted", "kilonova.mostOf"
#: rows of whole keys that one task works on
PART_ROWS = 1_000_000
#: up to so many cut points a slice is found by a tree of comparisons in generated code
TREE = 256


def slice_rows(df: DataFrame) -> int:
    """Rows per slice: the session setting ``kilonova.sliceRows``, else ``SLICE_ROWS``."""
    return int(df.sparkSession.conf.get(SLICE_ROWS_CONF, None) or SLICE_ROWS)


def one_slice(df: DataFrame, rows: int | None = None) -> bool:
    """Whether ``df`` is certainly small: by the bytes of its largest source, without a job, or else by its rows."""
    rows = rows or slice_rows(df)
    return small_files(df, rows) or _rows_at_most(df) <= rows


def _rows_at_most(df: DataFrame) -> int:
    """The rows of ``df``: a bound left by ``measured``, else counted."""
    known = [f.metadata[ROWS] for f in df.schema if ROWS in f.metadata]
    return min(known) if known else df.count()


def measured(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df``, a stored table, counted once for all steps per ``keys`` (or more columns) that keep or drop rows, but add none:
    the first key's metadata says whether some key is too large to stay whole and how many rows there are."""
    if any(MOST_ROWS in df.schema[k].metadata for k in keys) or small_files(df, slice_rows(df)):
        return df
    most, rows = _rows_of(df, keys)
    known = {COUNTED: keys, MOST_OF: most} if most <= min(slice_rows(df), KEY_ROWS) else {CUT: True}
    return df.withMetadata(keys[0], df.schema[keys[0]].metadata | known | {ROWS: rows})


def times_rows(df: DataFrame, key: str, times: int) -> DataFrame:
    """``df`` after a step that made ``times`` rows of one, with the bound of ``measured`` corrected."""
    known = df.schema[key].metadata
    return df.withMetadata(key, known | {ROWS: known[ROWS] * times}) if ROWS in known else df


def stored(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` checkpointed where its keys are known to be cut: every later step runs its input for cut points, carries and
    rows, and steps upon steps would run the first ones again each time."""
    return df.checkpoint() if any(CUT in df.schema[k].metadata for k in keys) else df


def small_files(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` is certainly below ``rows`` rows by the bytes of its largest source, without a job."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    largest = max((int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())), default=0)
    return largest <= rows * LEAST_ROW_BYTES


def sized(df: DataFrame, key: str) -> tuple[int, int] | None:
    """The rows of the largest ``key`` and of the whole table, for the adapters to leave the first in the key's metadata
    (steps that keep or drop rows, but add none, keep that bound); None for tables of small files, which aren't counted."""
    return None if small_files(df, slice_rows(df)) else _rows_of(df, [key])


def _rows_of(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    most, rows = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    return most or 0, rows or 0


def deal(df: DataFrame, key: str, rows: int) -> DataFrame:
    """``df`` of ``rows`` rows dealt by ``key``; where the session's number of partitions would give a task more than
    ``PART_ROWS`` rows, by as many as that takes."""
    parts = -(-rows // PART_ROWS)
    return df.repartition(parts, key) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(key)


def whole_keys(df: DataFrame, keys: list[str], rows: int | None = None) -> bool:
    """Whether every key of ``df`` has at most ``KEY_ROWS`` (or ``rows``, if fewer) rows: known from ``sized``, else counted
    unless ``df`` is a single slice."""
    rows = rows or slice_rows(df)
    limit = min(rows, KEY_ROWS)
    known = [m for k in keys if k in df.columns and (m := df.schema[k].metadata.get(MOST_ROWS)) is not None]
    if known and min(known) <= limit:
        return True
    named = [df.schema[k].metadata for k in keys if k in df.columns]
    if any(CUT in m for m in named):
        return False
    if any(set(m.get(COUNTED, ["?"])) <= set(keys) and m[MOST_OF] <= limit for m in named):
        return True
    if small_files(df, rows):
        return False   # one slice of any keys
    return _rows_of(df, keys)[0] <= limit


def cut_points(df: DataFrame, order: str, rows: int | None = None, keys: list[str] | None = None) -> list[float]:
    """Values that cut the range of ``order`` into slices of about ``rows`` rows (empty: one slice).  With ``keys``, keys
    that are all small need none."""
    rows = rows or slice_rows(df)
    if small_files(df, rows) or keys and whole_keys(df, keys, rows) or (n := _rows_at_most(df)) <= rows:
        return []
    slices = -(-n // rows)
    probs = ", ".join(f"{i / slices!r}D" for i in range(1, slices))
    accuracy = max(20 * TREE, 4 * slices)
    got = df.agg(F.expr(f"percentile_approx(CAST(`{order}` AS DOUBLE), array({probs}), {accuracy})").alias("c")).first()["c"]
    return sorted(set(got or []))


def slice_sql(column: str, cuts: list[float]) -> str:
    """SQL text: number of cut points <= ``column`` (binary search); -1 for NULL."""

    def tree(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        return f"CASE WHEN {column} < {cuts[mid]!r}D THEN {tree(lo, mid)} ELSE {tree(mid + 1, hi)} END"

    if len(cuts) <= TREE:
        found = tree(0, len(cuts))
    else:  # the same search as a fold over falling steps through the array of cut points
        steps = ", ".join(str(1 << k) for k in reversed(range(len(cuts).bit_length())))
        points = f"array({', '.join(f'{c!r}D' for c in cuts)})"
        found = f"aggregate(array({steps}), 0, (i, s) -> CASE WHEN get({points}, i + s - 1) <= {column} THEN i + s ELSE i END)"
    return f"CASE WHEN {column} IS NULL THEN -1 ELSE {found} END"
