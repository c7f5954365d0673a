"""Principal components of sequences in long form (M14), without a matrix anywhere.

The matrix has one row per object and one column per (band, slot, channel); its
cells are the long rows of ``sequences.scaled_rows``, absent cells are 0.  Its
leading components come from a block of ``k`` + ``extra`` seeded directions, held
as a table by (band, slot), that is multiplied by the covariance again and again
(randomised subspace iteration):

    y[object] = sum of cells x direction           one join by (band, slot), sums by object
    z[band, slot] = sum of cells x (y - mean y)    one join by object, sums by (band, slot)

Subtracting the mean of y centres the columns, so no column mean is stored, and
both products are partial sums on the map side.  Only products of the block with
itself, (k + extra) squared numbers, reach the driver: they make the directions
orthonormal and, at the end, turn them into components (Rayleigh-Ritz).  A series
of any length is just more (band, slot) keys; both joins are left to AQE, which
broadcasts a side by its measured size or splits a slot that all objects share.

The block and the scores are written to the shared folder every round, so a lost executor
costs one round at most.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..sources.io import scratch_path

CELL = ["passband", "slot"]
#: eigenvalues below this share of the largest are rounding errors of the sums
NOISE = 1e-12
#: slots of an object stored in one place
PLACE = 65_536


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def gram(df: DataFrame, groups: list[list[str]]) -> tuple[np.ndarray, np.ndarray, int]:
    """Sums over all rows (and ``groups``) of the products of a group's columns with each other, the sums of the columns, and
    the number of rows.  Every task adds its rows up to one small matrix; Spark adds the matrices."""
    size = len(groups[0])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums, n = np.zeros((size, size)), np.zeros(size), 0
        for batch in batches:
            for names in groups:
                block = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
                total += block.T @ block
                sums += block.sum(axis=0)
            n += batch.num_rows
        cells = np.concatenate([total.ravel(), sums, [n]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], names=["at", "v"])

    parts = df.select(*[c for names in groups for c in names]).mapInArrow(partial, "at long, v double")
    got = np.zeros(size * size + size + 1)
    for r in parts.groupBy("at").agg(F.sum("v").alias("v")).collect():   # (k + extra) squared and a few numbers
        got[r["at"]] = r["v"]
    return got[:size * size].reshape(size, size), got[size * size:-1], int(got[-1])


def turned(df: DataFrame, key: str, names: list[str], less: np.ndarray, by: np.ndarray, to: list[str]) -> DataFrame:
    """``key`` and, under ``to``, the columns ``names`` less a row of numbers, times a small matrix."""

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
            out = (block - less) @ by
            yield pa.RecordBatch.from_arrays([batch.column(key), *(pa.array(c) for c in out.T)], names=[key, *to])

    schema = StructType([df.schema[key], *(StructField(c, DoubleType()) for c in to)])
    return df.select(key, *names).mapInArrow(product, schema)


def _names(prefix: str, width: int) -> list[str]:
    return [f"_{prefix}{j}" for j in range(width)]


def encode_rows(rows: DataFrame, k: int = 16, channels: tuple[str, ...] = ("lag", "flux"), extra: int = 16, rounds: int = 12,
                tolerance: float = 1e-4, seed: int = 71) -> DataFrame:
    """M14 on long rows (object_id, passband, slot, channels): ``object_id``, ``encoding`` with ``k`` numbers, the row's cells
    times the ``k`` leading principal components (columns centred for the components, cells as they are for the projection,
    as Spark's own PCA has it).  Objects that hold no row have no encoding.

    ``extra``: directions beyond ``k``.  Rounds end when the block's largest ``k`` variances change by at most ``tolerance``
    of the largest, or after ``rounds``.  With at most ``k`` + ``extra`` columns in all the result is exact after the first
    round; otherwise each round shrinks the error by the ratio of the variances after and at a component.  A component's
    sign is open.  NULL and non-finite cells count as 0, rows without object, band or slot are no cells, repeated (object, band, slot) add
    up; what a narrower matrix (or one object) cannot give is 0."""
    cells_sum = {c: f"coalesce(sum(CASE WHEN abs(`{c}`) < double('Infinity') THEN CAST(`{c}` AS DOUBLE) END), 0D) AS `{c}`" for c in channels}
    # an object's cells lie together, as far as PLACE slots reach, so its partial sums are few
    x = (rows.dropna(subset=["object_id", *CELL]).withColumn("_part", F.floor(F.col("slot") / PLACE)).repartition("object_id", "_part")
         .groupBy("object_id", "_part", *CELL).agg(*[F.expr(v) for v in cells_sum.values()]).drop("_part"))
    x = _stored(x, "encode-cells")
    width = k + extra
    per_channel = {c: _names(f"w_{i}_", width) for i, c in enumerate(channels)}
    blocks, y_names = list(per_channel.values()), _names("y", width)

    def normal(name: str) -> str:   # Box-Muller on two hashes of the cell, the same however the table is stored
        u, v = (f"((xxhash64(passband, slot, '{name}', {i}, {seed}) & 9007199254740991) + 1) / 9007199254740993D" for i in (0, 1))
        return f"sqrt(-2 * ln({u})) * cos(2 * pi() * ({v})) AS `{name}`"

    w = x.select(*CELL).distinct().selectExpr(*CELL, *[normal(n) for names in blocks for n in names])
    w = _stored(w, "encode-block")
    product = {n: " + ".join(f"`{c}` * `{per_channel[c][j]}`" for c in channels) for j, n in enumerate(y_names)}
    none = np.zeros(width)
    before = None
    for step in range(rounds + 1):
        lengths, _, cells = gram(w, blocks)
        values, vectors = np.linalg.eigh(lengths)
        good = values > NOISE * max(values.max(initial=0.0), np.finfo(float).tiny)
        if not cells or not good.any():
            break
        turn = vectors[:, good] / np.sqrt(values[good])   # the block times this is orthonormal
        y = x.join(w, CELL).groupBy("object_id").agg(*[F.expr(f"sum({p}) AS `{n}`") for n, p in product.items()])
        y = _stored(y, "encode-scores")
        squares, sums, n = gram(y, [y_names])
        mean = sums / n
        variances, axes = np.linalg.eigh(turn.T @ (squares - n * np.outer(mean, mean)) @ turn)
        variances, axes = variances[::-1].clip(min=0.0), (turn @ axes)[:, ::-1]   # the block times ``axes``: components
        real = variances > NOISE * max(variances.max(), np.finfo(float).tiny)
        variances, axes = variances[real], axes[:, real]
        top = np.pad(variances[:k], (0, k - len(variances[:k])))
        still = before is not None and np.abs(top - before).max() <= tolerance * top.max()
        if still or step == rounds or not len(variances):
            axes = np.pad(axes[:, :k], ((0, 0), (0, k - axes[:, :k].shape[1])))
            out = turned(y, "object_id", y_names, none, axes, _names("e", k))
            return out.select("object_id", F.array(*_names("e", k)).alias("encoding"))
        before = top
        level = np.pad(axes / np.sqrt(variances), ((0, 0), (0, width - axes.shape[1])))   # keeps the next block well conditioned
        centred = turned(y, "object_id", y_names, mean, level, y_names)
        z = x.join(centred, "object_id").groupBy(*CELL).agg(*[
            F.expr(f"sum(`{c}` * `{n}`) AS `{per_channel[c][j]}`") for c in channels for j, n in enumerate(y_names)])
        w = _stored(z, "encode-block")
    return x.select("object_id").distinct().select("object_id", F.array_repeat(F.lit(0.0), k).alias("encoding"))
