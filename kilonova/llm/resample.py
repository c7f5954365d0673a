"""Operator 13: target-distribution importance resampling.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the whole text with A-Z lower-cased; features are all runs of one to
three of them, hashed by CRC-32 into an array of buckets.  The corpus and the target are counted by bucket (an array a
task, summed by Spark), each bucket gets a whole-numbered log-odds gain, and a second scan adds the gains of a document
by array look-ups.  A Gumbel number made of seed and id is added, which makes the highest scores a sample without
replacement.  The ranks come from parallel sorting by regular sampling (``sorted_ranks``).

CRCs are linear: the state after a text and a word is the text's state moved on by the word's length, xor the word's own
raw CRC.  So the words' bytes are read once, and each run takes one table look-up per byte of the state.

A null text has no words and weight 0.  A null id is hashed as the empty text and comes after all ids of its score;
repeated rows and equal scores are parted by their place in the table.  An empty corpus gives no row, an empty target
gains from the smoothing alone.  Other columns, whatever their names, are not read.
"""
from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_of
from .sorted_ranks import ranked, sorted_runs

#: production parameters
BUCKETS = 10_000
ORDER = 3
MIN_WORDS = 20
PERCENT = 5
SEED = 42

_CHUNK = 1 << 19  # bytes of text worked on at once; a longer text is cut between words
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

# -- CRC-32 by tables ----------------------------------------------------------------------------------------------

_NEAR = 64  # moves up to this length have tables of their own


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, np.uint32(0xEDB88320) ^ (t >> 1), t >> 1)
    return t.astype(np.uint32)


_CRC = _table()


def _one(s: np.ndarray) -> np.ndarray:
    """States moved on by one zero byte."""
    return _CRC[s & np.uint32(255)] ^ (s >> np.uint32(8))


def _apply(moves: np.ndarray, at, s: np.ndarray) -> np.ndarray:
    """States moved on by the tables that begin at ``at`` (four tables of 256 by byte of the state)."""
    return (moves[at + (s & np.uint32(255))] ^ moves[at + 256 + (s >> np.uint32(8) & np.uint32(255))]
            ^ moves[at + 512 + (s >> np.uint32(16) & np.uint32(255))] ^ moves[at + 768 + (s >> np.uint32(24))])


def _move_tables() -> tuple[np.ndarray, np.ndarray]:
    """Tables for moves of 0 .. _NEAR bytes and of 1, 2, 4, ... bytes."""
    same = (np.arange(256, dtype=np.uint32) << (np.arange(4, dtype=np.uint32) * 8)[:, None]).ravel()
    near, twice = [same], [_one(same)]
    for _ in range(_NEAR):
        near.append(_one(near[-1]))
    for _ in range(31):
        twice.append(_apply(twice[-1], np.int64(0), twice[-1]))
    return np.concatenate(near), np.concatenate(twice)


def _from_end() -> np.ndarray:
    """Raw CRC of a byte that so many others follow."""
    rows = [_CRC]
    for _ in range(_NEAR - 1):
        rows.append(_one(rows[-1]))
    return np.concatenate(rows)


_MOVES, _DOUBLES = _move_tables()
_ENDING = _from_end()
_BLANK = _CRC[32]
_ALL = np.uint32(0xFFFFFFFF)


def _moved(s: np.ndarray, length: np.ndarray) -> np.ndarray:
    """States moved on by ``length`` zero bytes each."""
    out = _apply(_MOVES, np.minimum(length, _NEAR) << 10, s)
    far = np.flatnonzero(length > _NEAR)
    if len(far):
        s, rest = s[far], length[far].copy()
        for k in range(int(rest.max()).bit_length()):
            odd = rest >> k & 1 == 1
            s[odd] = _apply(_DOUBLES, np.int64(k << 10), s[odd])
        out[far] = s
    return out


def _words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, length and raw CRC of the words of ``data``; no word crosses a byte of ``starts``."""
    word = _WORD[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = starts[starts < len(data)]
    first[inner] |= word[inner]
    begin = np.flatnonzero(first)
    if not len(begin):
        return begin, begin, np.zeros(0, np.uint32)
    at = np.flatnonzero(word)
    cut = np.flatnonzero(first[at])
    size = np.diff(np.append(cut, len(at)))
    behind = np.repeat(cut + size, size) - 1 - np.arange(len(at))
    low = _LOWER[data[at]]
    val = _ENDING[(np.minimum(behind, _NEAR - 1) << 8) + low]
    raw = np.bitwise_xor.reduceat(val, cut)
    for i in np.flatnonzero(size > _NEAR).tolist():
        raw[i] = zlib.crc32(low[cut[i]:cut[i] + size[i]].tobytes(), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return begin, size, raw


def _features(data: np.ndarray, starts: np.ndarray, buckets: int, carry):
    """Words a text, text of each feature, bucket of each feature, and what a following piece of the last text needs:
    the states of the runs that end at its last word."""
    begin, size, raw = _words(data, starts)
    text = np.searchsorted(starts, begin, "right") - 1
    n = len(begin)
    states, texts = [], []
    state, alive = _moved(np.full(n, _ALL), size) ^ raw, np.ones(n, bool)
    joined = _moved(np.full(n, _BLANK), size) ^ raw
    kept = []
    for k in range(ORDER):
        if k:
            back = np.empty(n, np.uint32)
            back[1:] = state[:-1]
            on = np.zeros(n, bool)
            on[1:] = alive[:-1] & (text[1:] == text[:-1])
            if n and carry and text[0] == 0 and len(carry) >= k:
                back[0], on[0] = carry[k - 1], True
            back[~on] = 0
            state, alive = _moved(back, size + 1) ^ joined, on
        states.append(state[alive])
        texts.append(text[alive])
        if n and alive[-1]:
            kept.append(state[-1])
    h = (np.concatenate(states) ^ _ALL) % np.uint32(buckets)
    return np.bincount(text, minlength=len(starts)), np.concatenate(texts), h, (kept if n else carry)


def features(texts: pa.Array, buckets: int = BUCKETS):
    """Yields (first text, words a text, text of each feature, bucket of each feature) for runs of texts; a long text
    comes in several pieces."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = min(max(i + 1, int(np.searchsorted(offs, offs[i] + _CHUNK, "right")) - 1), len(texts))
        at, end, carry = int(offs[i]), int(offs[j]), None
        while True:
            upto = end
            if j == i + 1 and end - at > _CHUNK:  # cut a long text at the next byte that no word holds
                upto = at + _CHUNK
                while upto < end and (gap := np.flatnonzero(~_WORD[data[upto:min(end, upto + _CHUNK)]]))[:1].size == 0:
                    upto = min(end, upto + _CHUNK)
                upto = upto + int(gap[0]) if upto < end else end
            starts = offs[i:j] - offs[i] if j > i + 1 else np.zeros(1, np.int64)
            words, text, h, carry = _features(data[at:upto], starts, buckets, carry)
            yield i, words, text, h
            at = upto
            if at >= end:
                break
        i = j


# -- Spark ---------------------------------------------------------------------------------------------------------

def _count(buckets: int):
    def count(batches):
        n = np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, _, h in features(column_of(b, "text"), buckets):
                n += np.bincount(h, minlength=buckets)
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(n[held])], names=["bucket", "n"])
    return count


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket.  A task sends one row a bucket, the driver gets one row a bucket."""
    counts = texts.select(F.col(text).alias("text")).mapInArrow(_count(buckets), "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in counts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the smoothed ratio of shares) of every bucket."""
    k, s, t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(b) + 1) * (s + k) / ((float(a) + 1) * (t + k))))
                     for a, b in zip(source.tolist(), target.tolist())], np.int64)


def gumbel(seed: int, key: str | None) -> int:
    h = int(hashlib.sha256(f"{seed}:{key or ''}".encode("utf-8", "surrogatepass")).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _score(gains: np.ndarray, seed: int):
    def score(batches):
        buckets = len(gains)
        for b in batches:
            n = b.num_rows
            words, grams, weight = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for i, w, text, h in features(column_of(b, "text"), buckets):
                words[i:i + len(w)] += w
                grams[i:i + len(w)] += np.bincount(text, minlength=len(w))
                # doubles hold these sums exactly: far below 2 ** 53
                weight[i:i + len(w)] += np.bincount(text, weights=gains[h], minlength=len(w)).astype(np.int64)
            noise = np.array([gumbel(seed, k) for k in b.column("name").to_pylist()], np.int64)
            keep = [k for k, name in enumerate(b.schema.names) if name not in ("text", "name")]
            yield pa.RecordBatch.from_arrays([*(b.columns[k] for k in keep), *map(pa.array, (words, grams, weight, weight + noise))],
                                             names=[*(b.schema.names[k] for k in keep), "n_words", "n_features", "weight", "score"])
    return score


def score_texts(docs: DataFrame, gains: np.ndarray, key: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """key, n_words, n_features, weight, score of every row."""
    src = docs.select(F.col(key).alias("key"), F.col(key).cast("string").alias("name"), F.col(text).alias("text"))
    kind = src.schema["key"].dataType.simpleString()
    return src.mapInArrow(_score(gains, seed), f"key {kind}, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
             buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """``key``, n_words, n_features, weight, score and rank of every row; rank is null for rows that aren't drawn.  Of
    the N rows with at least ``min_words`` words the floor(percent * N / 100) highest scores are drawn."""
    gains = bucket_gains(bucket_counts(docs, text, buckets), bucket_counts(target, target_text, buckets))
    scored = score_texts(docs, gains, key, text, seed)
    kind = scored.schema["key"].dataType
    rows = scored.select("key", "n_words", "n_features", "weight", "score", (F.col("n_words") < min_words).cast("int").alias("short"),
                         (-F.col("score")).alias("low"), F.col("key").isNull().cast("int").alias("no_key"),
                         F.coalesce("key", F.lit(0).cast(kind)).alias("id"))
    order = ["short", "low", "no_key", "id"]
    runs = sorted_runs(rows, order, "resample")
    drawn = percent * runs.where("short = 0").count() // 100
    return ranked(runs, order, "resample").select(
        F.col("key").alias(key), "n_words", "n_features", "weight", "score", F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
