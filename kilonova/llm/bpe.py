"""Operator 9: byte-level BPE encoding and decoding by tree reduction over a monoid.

Two levels, each with an associative join:

* A *pre-token* (one match of the pattern) is encoded by halves.  Two neighbouring encodings join by concatenation when
  the pair of tokens at the seam is compatible, that is, when merging their bytes alone gives the same two tokens again.
  Otherwise a window of tokens around the seam is encoded anew; it grows on the side whose outer pair is still
  incompatible.  A sequence in which every adjacent pair is compatible is the encoding of its bytes (merges never cross
  a compatible seam), so the tokens outside the window are provably stable when both outer pairs are compatible.
* A *text* beyond ``LEAF`` characters is cut in halves, too.  A match depends on the text from its start to one
  character behind its end, so all matches of the left half but the last are stable; matching goes on from the start of
  that last one into the right half until a match ends where one of the right half's ends.  From there on both agree.

Decoding maps ids to bytes and concatenates up the tree.  Null and empty texts have no tokens.  Texts are never cut;
every row is encoded for itself, repeated or not.
"""
from __future__ import annotations

import base64
import hashlib
import heapq
from bisect import bisect_left
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF = 1 << 16  # characters of a text that are matched in one go
_LEAF_BYTES = 4  # bytes of a pre-token that are merged directly
_SHORT = 32  # bytes up to which a list is faster than a heap
_CACHE = 400_000  # pre-tokens (parts, windows, seams) in a generation of a worker's memory; bounds its size


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class _Known(dict):
    """Remembers results in two generations of at most ``_CACHE`` entries; what is still in use moves to the new one."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(self) >= _CACHE:
            self.old = dict(self)
            self.clear()
        self[key] = got
        return got


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        size = max(ranks.values()) + 1
        self.bytes_of, self.text_of = [b""] * size, [str(i) for i in range(size)]
        for b, i in ranks.items():
            self.bytes_of[i] = b
        self.known = _Known(lambda piece: self.encode_piece(piece.encode("utf-8", "replace")))
        self.fits = _Known(lambda pair: self._merged(self.bytes_of[pair[0]] + self.bytes_of[pair[1]]) == list(pair))
        self.parts = _Known(self._tree)  # halves and windows recur far more often than whole pre-tokens
        self.windows = _Known(self._merged)

    # -- one pre-token
    def _merged(self, data: bytes) -> list[int]:
        """Tokens of some bytes: the adjacent pair of least rank is merged first, the leftmost of equals."""
        ranks = self.ranks
        n = len(data)
        if n <= _SHORT:
            parts = [data[i:i + 1] for i in range(n)]
            pair = [ranks.get(data[i:i + 2], 1 << 60) for i in range(n - 1)]
            while pair:
                low = min(pair)
                if low == 1 << 60:
                    break
                i = pair.index(low)
                parts[i:i + 2] = [parts[i] + parts[i + 1]]
                del pair[i]
                if i < len(pair):
                    pair[i] = ranks.get(parts[i] + parts[i + 1], 1 << 60)
                if i:
                    pair[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 60)
            return [ranks[p] for p in parts]
        # many bytes: the same order of merges from a heap over a linked list
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts at i
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i:i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue
            j = end[i]
            alive[j], end[i] = False, stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(data[i:end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (h := before[i]) >= 0 and (r := ranks.get(data[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i:end[i]]])
            i = end[i]
        return out

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """The encoding of two neighbouring strings from their encodings."""
        if not a or not b:
            return a + b
        if self.fits[a[-1], b[0]]:
            return a + b
        i = j = 1
        while True:
            seam = b"".join([self.bytes_of[t] for t in chain(a[len(a) - i:], b[:j])])
            window = self.windows[seam] if len(seam) <= 16 else self._merged(seam)
            left = i == len(a) or self.fits[a[-i - 1], window[0]]
            right = j == len(b) or self.fits[window[-1], b[j]]
            if left and right:
                return a[:len(a) - i] + window + b[j:]
            if not left:
                i = min(len(a), 2 * i)
            if not right:
                j = min(len(b), 2 * j)

    def _tree(self, data: bytes) -> list[int]:
        if len(data) <= _LEAF_BYTES:
            return self._merged(data)
        half = len(data) // 2
        parts = self.parts if half <= 8 else None
        a, b = (parts[data[:half]], parts[data[half:]]) if parts is not None else (self._tree(data[:half]), self._tree(data[half:]))
        return self.join(a, b)

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        return self._tree(data) if whole is None else [whole]

    # -- a text
    def _ends(self, text: str, lo: int, hi: int) -> list[int]:
        """Ends of the matches of text[lo:hi] as if it stood alone."""
        if hi - lo <= LEAF:
            return [m.end() for m in self.pattern.finditer(text, lo, hi)]
        mid = (lo + hi) // 2
        a, b = self._ends(text, lo, mid), self._ends(text, mid, hi)
        at = a[-2] if len(a) > 1 else lo
        seam = []
        while True:
            at = self.pattern.match(text, at, hi).end()
            seam.append(at)
            k = bisect_left(b, at)
            if at >= mid and (at == mid or k < len(b) and b[k] == at):
                return a[:-1] + seam + b[k + (at != mid):]

    def encode(self, text: str) -> list[int]:
        if len(text) <= LEAF:
            pieces = self.pattern.findall(text)
        else:
            ends = self._ends(text, 0, len(text))
            pieces = [text[i:j] for i, j in zip([0, *ends], ends)]
        return list(chain.from_iterable(map(self.known.__getitem__, pieces)))

    def decode(self, ids: list[int]) -> bytes:
        leaves = [b"".join(map(self.bytes_of.__getitem__, ids[i:i + 4096])) for i in range(0, len(ids), 4096)]
        return b"".join(leaves)


_HELD: dict[tuple, Bpe] = {}


def held(ranks, pattern: str) -> Bpe:
    """One encoder for each worker process and vocabulary (``ranks``: a broadcast)."""
    key = (ranks.value[0], pattern)
    if key not in _HELD:
        _HELD[key] = Bpe(ranks.value[1], pattern)
    return _HELD[key]


def _digests(ranks, pattern: str, with_ids: bool):
    def run(batches):
        bpe = held(ranks, pattern)
        for b in batches:
            n, ids_sha, raw_sha, all_ids = [], [], [], []
            for t in b.column("text"):
                ids = bpe.encode(t.as_py() or "")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(bpe.text_of.__getitem__, ids)).encode()).hexdigest())
                raw_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                if with_ids:
                    all_ids.append(ids)
            cols = [b.column("row"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(raw_sha, pa.string())]
            names = ["row", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols.append(pa.array(all_ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)
    return run


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per row of ``docs``: ``row`` (its other columns), n_tokens, ids_sha256, decoded_sha256 and, unless
    ``with_ids`` is off, ids.  ``ranks_path``: a rank file on the driver; it is broadcast (its size is fixed by the
    vocabulary, not by the data)."""
    with open(ranks_path, "rb") as f:
        name = hashlib.sha256(f.read()).hexdigest()
    ranks = docs.sparkSession.sparkContext.broadcast((name, read_ranks(ranks_path)))
    rest = [docs[c] for c in docs.columns if c != text]
    src = docs.select(F.struct(*rest).alias("row"), docs[text].alias("text"))
    schema = f"row {src.schema['row'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return src.mapInArrow(_digests(ranks, pattern, with_ids), schema + ", ids array<int>" * with_ids)


def _decode(ranks, pattern: str):
    def run(batches):
        bpe = held(ranks, pattern)
        for b in batches:
            texts = [None if x is None else bpe.decode(x) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.binary())], names=["row", "decoded"])
    return run


def decode_ids(encoded: DataFrame, ranks_path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``row`` (the other columns) and decoded (the bytes) of rows with token ids; null ids stay null."""
    ranks = encoded.sparkSession.sparkContext.broadcast((ranks_path, read_ranks(ranks_path)))
    rest = [encoded[c] for c in encoded.columns if c != ids]
    src = encoded.select(F.struct(*rest).alias("row"), encoded[ids].cast("array<int>").alias("ids"))
    return src.mapInArrow(_decode(ranks, pattern), f"row {src.schema['row'].dataType.simpleString()}, decoded binary")
