"""Operator 4: toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; all other training text counts as unlabelled, whatever its label.  A linear
classifier over the presence of words and word beginnings is fitted in numpy by the class-prior-corrected risk

    R = prior * R_pos(+1) + max(0, R_unl(-1) - prior * R_pos(-1))

with logistic loss; where the second part falls below zero, the step goes against it (the non-negative correction).
The class prior is the share of toxic rows among the labelled training rows.  The fit sees samples of bounded size (a
parameter), drawn by a hash of the id and reduced to word hashes by Spark before they reach the driver; the model is a
table of at most ``words`` weights, so its broadcast is bounded, too.  Scoring reads every whole text.

Words are runs of letters (ASCII letters, lower-cased, and all characters beyond ASCII); the first 4 to 9 bytes
of longer words count besides, as one stem takes many endings.  Null, empty and wordless
texts score by the bias alone.  Rows without an id are scored but teach nothing; several labels of an id count as toxic
if one is; without positives, every score is 0.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_LETTERS, column_of, crc_mod, mix, word_hashes


HEADS = (4, 5, 6, 7, 8, 9)


@dataclass(frozen=True)
class Params:
    """Production parameters; the two sample sizes bound what reaches the driver."""

    positives: int = 3_000
    unlabelled: int = 6_000
    words: int = 4_096
    min_share: float = 0.02  # of the positives that a word of the model occurs in (and at least five)
    min_z: float = 2.5  # standard errors by which its share among positives must exceed that among unlabelled texts
    min_posterior: float = 0.9  # prior * share among positives / share among unlabelled: how far a word alone speaks for toxic
    steps: int = 600
    rate: float = 0.1
    decay: float = 1e-5  # L2


@dataclass
class Model:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float
    prior: float


def _distinct_words(batches):
    for b in batches:
        out = []
        for _, n, h in word_hashes(b.column("text"), NOT_LETTERS, HEADS):
            at = np.append(0, np.cumsum(n))
            out += [np.unique(h[i:j]).tobytes() for i, j in zip(at, at[1:])]
        yield pa.RecordBatch.from_arrays([b.column("positive"), pa.array(out, pa.binary())], names=["positive", "words"])


def _loss(z):
    return np.logaddexp(0, -z)


def fit(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, params: Params = Params()) -> Model:
    """The classifier from two samples of texts, each an array of distinct word hashes."""
    none = Model(np.zeros(0, np.uint64), np.zeros(0), -50.0, prior)
    if not pos or not 0 < prior < 1:
        return none
    flat = np.concatenate(pos)
    words, df = np.unique(flat, return_counts=True)
    keep = df >= max(5, params.min_share * len(pos))
    words, df = words[keep], df[keep]
    if not len(words):
        return none
    columns = lambda texts: [np.searchsorted(words, t[np.isin(t, words, assume_unique=True)]) for t in texts]
    x_pos, x_unl = columns(pos), columns(unl)
    in_unl = np.bincount(np.concatenate([*x_unl, np.zeros(0, int)]).astype(int), minlength=len(words))
    # words by how much more often positives hold them, in standard errors of the difference
    p, u = df / len(pos), (in_unl + 1) / (len(unl) + 2)
    z = (p - u) / np.sqrt(p * (1 - p) / len(pos) + u * (1 - u) / (len(unl) + 1) + 1e-9)
    z = np.where(prior * p / u >= params.min_posterior, z, -np.inf)
    top = np.argsort(-z, kind="stable")[:params.words]
    top = np.sort(top[z[top] >= params.min_z])
    if not len(top):
        return none
    place = np.full(len(words), -1)
    place[top] = np.arange(len(top))
    rows, cols = [], []
    for i, c in enumerate(x_pos + x_unl):
        c = place[c]
        c = c[c >= 0]
        rows.append(np.full(len(c), i))
        cols.append(c)
    rows, cols = np.concatenate(rows), np.concatenate(cols)
    n, n_pos, n_unl, k = len(pos) + len(unl), len(pos), max(1, len(unl)), len(top)
    w, bias = np.zeros(k), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, params.steps + 1):
        score = np.bincount(rows, w[cols], n) + bias
        sp, su = score[:n_pos], score[n_pos:]
        gp_plus = -1 / (1 + np.exp(np.clip(sp, -50, 50)))  # d loss(z) / dz
        gp_minus = 1 / (1 + np.exp(-np.clip(sp, -50, 50)))  # d loss(-z) / dz
        gu_minus = 1 / (1 + np.exp(-np.clip(su, -50, 50)))
        negative = (_loss(-su).sum() / n_unl) - prior * _loss(-sp).mean()
        g_minus = np.concatenate([-prior * gp_minus / n_pos, gu_minus / n_unl])
        g = np.concatenate([prior * gp_plus / n_pos, np.zeros(n - n_pos)]) + g_minus if negative >= 0 else -g_minus
        grad = np.append(np.bincount(cols, g[rows], k) + params.decay * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = params.rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return Model(words[top], w, bias, prior)


def one_of_copies(texts: list[np.ndarray]) -> list[np.ndarray]:
    """Texts of which no earlier one is a copy or near copy (they share one of four sketches of six words), so that the
    words of a copied toxic text don't count as signs of toxicity."""
    seen: set[tuple] = set()
    out = []
    for t in texts:
        keys = {(k, *np.sort(mix(t ^ np.uint64(k * 0x9E3779B9)))[:6].tolist()) for k in range(4)}
        if not keys & seen:
            out.append(t)
        seen |= keys
    return out


def train(docs: DataFrame, labels: DataFrame, params: Params = Params(), fold: int = 5) -> Model:
    """Fits on rows whose crc32(doc_id) modulo ``fold`` is not 0.  ``docs``: doc_id, text; ``labels``: doc_id, toxic."""
    seen = lambda d: d.where(F.col("doc_id").isNotNull() & (crc_mod("doc_id", fold) != 0))
    one = seen(labels).where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, n_pos = one.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).collect()[0]
    if not n_pos:
        return fit([], [], 0.0, params)
    draw = lambda share: F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1
    chosen = one.where((F.col("toxic") == 1) & draw(min(1.0, params.positives / n_pos))).limit(2 * params.positives).select("doc_id")
    ids = docs.sparkSession.createDataFrame([(r.doc_id,) for r in chosen.collect()], chosen.schema)  # bounded: broadcast below
    total = docs.count()
    src = docs.select("doc_id", "text")
    pos = src.join(F.broadcast(ids), "doc_id", "left_semi").select(F.lit(True).alias("positive"), "text")
    unl = seen(src).where(draw(min(1.0, params.unlabelled / max(1, total)))).select(F.lit(False).alias("positive"), "text")
    got = []
    for part, most in ((pos, 2 * params.positives), (unl, 2 * params.unlabelled)):
        rows = part.mapInArrow(_distinct_words, "positive boolean, words binary").limit(most).collect()
        got.append([np.frombuffer(x, np.uint64) for x in sorted(r.words for r in rows)])
    return fit(one_of_copies([x for x in got[0] if len(x)]), got[1], n_pos / n, params)


def scores(model: Model, texts: pa.Array) -> np.ndarray:
    out = []
    k = len(model.words)
    for _, n, h in word_hashes(texts, NOT_LETTERS, HEADS):
        z = np.full(len(n), model.bias)
        if k and len(h):
            at = np.searchsorted(model.words, h)
            at[at == k] = 0
            hit = np.flatnonzero(model.words[at] == h)
            doc = np.searchsorted(np.cumsum(n), hit, "right")
            pair = np.unique(doc * k + at[hit])
            z += np.bincount(pair // k, model.weights[pair % k], len(n))
        out.append(1 / (1 + np.exp(-np.clip(z, -500, 500))))
    return np.concatenate(out) if out else np.zeros(0)


def score_texts(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``row`` (its columns, the text only if asked for) and score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            texts = column_of(b, text if keep_text else "text")
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(scores(sent.value, texts), pa.float64())], names=["row", "score"])

    rest = [docs[c] for c in docs.columns if keep_text or c != text]
    src = docs.select(F.struct(*rest).alias("row"), *([] if keep_text else [docs[text].alias("text")]))
    return src.mapInArrow(run, f"row {src.schema['row'].dataType.simpleString()}, score double")
