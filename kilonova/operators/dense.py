"""Multilayer perceptrons over blocks of rows, with a weight per class, one for every fold left out.

Spark's estimator has no weight column and reads every copy of a row in each pass.  Here the rows are packed once as
cached matrices of at most ``BLOCK`` objects of one fold; a pass is one Spark job that sums loss and gradient over the
blocks, for the networks of all folds at once, and the driver holds the networks' weights alone.  Layers, loss and the flat
order of the weights are those of Spark's ``MultilayerPerceptronClassifier``: sigmoid layers, softmax, mean cross-entropy.
"""
from __future__ import annotations

from collections import deque

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame

from ..functions.slices import PART_ROWS

BLOCK = 1024   #: objects a matrix: what a pass makes of one stays in the processor's cache


def _pack(batches):
    """Rows (x, label, fold) -> matrices with one column an object."""
    import pyarrow as pa

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        x = np.asarray(batch.column("x").flatten()).reshape(n, -1)
        label, fold = (batch.column(c).to_numpy().astype(np.int64) for c in ("label", "fold"))
        if label.min() < 0:
            raise ValueError("a row's class is none of the classes given")
        cut = []
        for f in np.unique(fold):
            at = np.flatnonzero(fold == f)
            cut += [(f, at[i:i + BLOCK]) for i in range(0, len(at), BLOCK)]
        yield pa.RecordBatch.from_arrays([
            pa.array([np.ascontiguousarray(x[at].T).tobytes() for _, at in cut], pa.binary()),
            pa.array([label[at].tobytes() for _, at in cut], pa.binary()),
            pa.array([int(f) for f, _ in cut], pa.int64())], names=["x", "label", "fold"])


def _matrix(row):
    label = np.frombuffer(row.label, np.int64)
    return np.frombuffer(row.x).reshape(-1, len(label)), label, row.fold


def row_blocks(df: DataFrame, rows: int):
    """RDD of (matrix, labels, fold) from ``rows`` rows (x array<double>, label long, fold long); persisted, the caller
    unpersists it.  Each pass starts a Python task a part: as few parts as keep all cores busy and hold ``PART_ROWS`` each."""
    packed = df.mapInArrow(_pack, "x binary, label binary, fold long")
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = cores * max(1, -(-rows // (cores * PART_ROWS)))
    return packed.rdd.coalesce(parts).map(_matrix).persist(StorageLevel.MEMORY_AND_DISK_DESER)


def _layers(w: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    """The flat weights as one matrix a layer, intercepts last."""
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:]):
        out.append(w[at:at + (a + 1) * b].reshape(a + 1, b))
        at += (a + 1) * b
    return out


def block_sums(w: np.ndarray, sizes: list[int], scale, class_weight: np.ndarray, x: np.ndarray, label: np.ndarray,
               room: dict) -> np.ndarray:
    """Weight, loss and gradient of a network on one block, each summed over its rows.  ``scale`` is (mean, factor) of each
    feature, ``room`` keeps the matrices between calls."""
    layers, at = _layers(w, sizes), np.arange(len(label))

    def kept(name, lines):
        if (name, len(label)) not in room:
            room[name, len(label)] = np.empty((lines, len(label)))
        return room[name, len(label)]

    act = [np.subtract(x, scale[0][:, None], out=kept("x", len(x)))]
    act[0] *= scale[1][:, None]
    for i, m in enumerate(layers):
        z = np.matmul(m[:-1].T, act[i], out=kept(("z", i), sizes[i + 1]))
        z += m[-1][:, None]
        if i < len(layers) - 1:
            np.negative(z, out=z)
            with np.errstate(over="ignore"):   # 1 / (1 + inf) is 0
                np.exp(z, out=z)
            z += 1
            act.append(np.reciprocal(z, out=z))
    z -= z.max(0)
    own, weight = z[label, at], class_weight[label]
    np.exp(z, out=z)
    total = z.sum(0)
    loss = weight @ (np.log(total) - own)
    z *= weight / total
    z[label, at] -= weight   # derivative by the last layer's sums
    grads = []
    for i in range(len(layers) - 1, -1, -1):
        grads += [z.sum(1), (act[i] @ z.T).ravel()]
        if i:
            z = np.matmul(layers[i][:-1], z, out=kept(("d", i), sizes[i]))
            z *= act[i]
            z *= np.subtract(1, act[i], out=act[i])
    return np.concatenate([[weight.sum(), loss], *grads[::-1]])


def mean_losses(blocks, sizes: list[int], scales: dict, class_weights: dict):
    """Function of the flat weights by fold left out: (weighted mean loss over the other folds' rows, its gradient) of each,
    in one pass over the blocks."""
    width = 2 + sum((a + 1) * b for a, b in zip(sizes, sizes[1:]))

    def values(points: dict) -> dict:
        def sums(part):
            out, room = {f: np.zeros(width) for f in points}, {}
            for x, label, fold in part:
                for f, w in points.items():
                    if f != fold:
                        out[f] += block_sums(w, sizes, scales[f], class_weights[f], x, label, room)
            return [np.array([out[f] for f in points])]

        total = blocks.mapPartitions(sums).reduce(np.add)
        return {f: (t[1] / t[0], t[2:] / t[0]) for f, t in zip(points, total)}
    return values


def _search(x, f, slope, d, step):
    """Step along ``d`` that lowers the value enough and flattens its slope (weak Wolfe conditions), by doubling and
    halving; None if there is no lower value."""
    low, high, best = 0.0, None, None
    for _ in range(20):
        at = x + step * d
        f1, g1 = yield at
        if not np.isfinite(f1) or f1 > f + 1e-4 * step * slope:
            high = step
        else:
            best = (at, f1, g1)
            if g1 @ d >= 0.9 * slope:
                break
            low = step
        step = 2 * step if high is None else (low + high) / 2
    return best


def _rounds(x: np.ndarray, max_iter: int, tol: float, memory: int):
    """Limited-memory BFGS as a generator: yields points, is sent (value, gradient) of each."""
    f, g = yield x
    pairs, history = deque(maxlen=memory), [f]
    while len(history) <= max_iter and np.linalg.norm(g) > max(tol * abs(f), 1e-8):
        d, coef = -g, []
        for s, y in reversed(pairs):
            coef.append((s @ d) / (s @ y))
            d = d - coef[-1] * y
        if pairs:
            s, y = pairs[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y), c in zip(pairs, reversed(coef)):
            d = d + (c - (y @ d) / (s @ y)) * s
        found = (yield from _search(x, f, g @ d, d, 1.0 if pairs else 1 / np.linalg.norm(g))) if g @ d < 0 else None
        if found is None:
            if not pairs:
                break
            pairs.clear()   # start again from the gradient
            continue
        at, f, after = found
        if (at - x) @ (after - g) > 0:
            pairs.append((at - x, after - g))
        x, g = at, after
        history.append(f)
        if max(history[-20:]) - f <= tol * abs(history[0]):
            break
    return x, history


def minimise(values, starts: dict, max_iter: int = 100, tol: float = 1e-6, memory: int = 10) -> dict:
    """Each start's point after the rounds and the value after each round (the start's first).  Rounds, memory and tolerance
    as Spark's estimator has them; ``values`` takes the points of all starts that go on at once."""
    runs = {k: _rounds(x, max_iter, tol, memory) for k, x in starts.items()}
    points, done = {k: next(run) for k, run in runs.items()}, {}
    while points:
        for k, value in values(points).items():
            try:
                points[k] = runs[k].send(value)
            except StopIteration as end:
                done[k] = end.value
                del points[k]
    return done
