"""Helpers shared by the corpus operators: tables, written intermediates, vectorised word hashing."""
from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: white space that separates words: space and U+0009..U+000D
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written once as Parquet below the shared checkpoint folder and read again: cuts the lineage, and a
    lost executor costs nothing that was written."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/tables/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column of a batch, or of its struct ``row`` (so that a text kept in the row isn't sent twice)."""
    if name in batch.schema.names:
        return batch.column(name)
    return batch.column("row").field(name)


def crc_mod(doc_id: str, mod: int) -> F.Column:
    """crc32 of the id's decimal text modulo ``mod``; a null id counts as the empty text (0)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % mod


# -- vectorised words ----------------------------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: all bytes but ASCII letters and those of characters beyond ASCII
NOT_LETTERS = np.ones(256, bool)
NOT_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 20  # bytes of text worked on at once; bounds the temporaries (a longer text is a chunk of its own)


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser (a bijection on 64 bits)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int) -> np.ndarray:
    p = np.full(n, _P, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


_TAG = np.uint64(0xD6E8FEB86659FD93)


def _words(data: np.ndarray, starts_at: np.ndarray, between: np.ndarray = _SPACE, heads: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of ``data`` (UTF-8 bytes, A-Z lower-cased) and the byte where each begins.
    ``starts_at``: first byte of each text; no word crosses it.  ``heads``: for each n, the first n bytes of every
    longer word count as one more word, different from any whole word."""
    word = ~between[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = starts_at[starts_at < len(data)]
    first[inner] |= word[inner]
    begin = np.flatnonzero(first)
    if not len(begin):
        return np.zeros(0, np.uint64), begin
    at = np.flatnonzero(word)
    cut = np.flatnonzero(first[at])  # index into ``at`` of each word's first byte
    size = np.diff(np.append(cut, len(at)))
    place = np.arange(len(at)) - np.repeat(cut, size)
    val = _LOWER[data[at]].astype(np.uint64)
    val += np.uint64(1)
    val *= _powers(int(size.max()))[place]
    h = np.add.reduceat(val, cut)
    h ^= size.astype(np.uint64) * _TAG
    if not heads:
        return mix(h), begin
    total = np.append(np.zeros(1, np.uint64), np.cumsum(val))
    hs, places = [h], [begin]
    for n in heads:
        long = size > n
        hs.append((total[cut[long] + n] - total[cut[long]]) ^ np.array([n], np.uint64) * _TAG ^ np.uint64(1 << 63))
        places.append(begin[long])
    place = np.concatenate(places)
    order = np.argsort(place, kind="stable")
    return mix(np.concatenate(hs)[order]), place[order]


def word_hashes(texts: pa.Array, between: np.ndarray = _SPACE, heads: tuple[int, ...] = ()):
    """Yields (first text, number of words of each text, hashes of all their words) for consecutive runs of texts.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; null counts as empty.  Two different words share a
    hash with probability 2**-64.  ``between``: which bytes separate words, if not the six of ``SPACES``;
    ``heads``: as in ``_words``.
    """
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
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + _CHUNK, "right")) - 1)
        j = min(j, len(texts))
        part = data[offs[i]:offs[j]]
        rel = offs[i:j + 1] - offs[i]
        h, begin = _words(part, rel[:-1], between, heads)
        yield i, np.diff(np.searchsorted(begin, rel)), h
        i = j
