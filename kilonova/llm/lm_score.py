"""Operator 3: language-model scores by a weighted backoff automaton.

The model is an n-gram model over lower-cased words and an end mark, smoothed towards the next shorter context:

    p(w | h) = (c(hw) + mass * p(w | h')) / (c(h) + mass),      p(w) = (c(w) + 0.1) / (N + 0.1 * (V + 1))

with h' the context without its first word, N training tokens and V distinct ones.  As an automaton: every context with
a count is a state; an n-gram with a count is an arc that carries log10 of the value above; every state has a failure
arc to its longest proper suffix that carries log10(mass / (c(h) + mass)); the root has an arc for every token.  A text
is read once from left to right: the state is the longest known suffix, failure arcs are followed until an arc for the
next token exists, and the weights on the way add up.

Counts cover all training text and are never pruned, so the model grows with the corpus and is never held in one place.
Texts are dealt into blocks of bounded size; each block asks for the n-grams that its own texts can reach (each once,
as 64-bit hashes, with its own counts), requests meet in buckets by hash where the counts of all blocks are added, and
the totals go back to the block, which builds its part of the automaton and reads its texts.  One shuffle of the text
serves both steps.

Null, empty and wordless texts are one end mark.  A null id counts as the empty id (held out).  Repeated rows are
scored, and counted, each for itself.  An empty table gives no rows.
"""
from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, word_hashes

#: production parameters
ORDER = 2
MASS = 50.0  # pseudo-count of the shorter context
BLOCK_TOKENS = 1_200_000  # of a block; bounds a task
HOLD_OUT = 10  # texts whose crc32(id) is divisible by it teach nothing

_END, _START = np.uint64(0x51D7E5EF0B1C3A29), np.uint64(0x2F0A7C9D4E8B6153)
_C = np.uint64(0x9FB21C651E98DF25)


def _held(keys: list) -> np.ndarray:
    return np.array([zlib.crc32(b"" if k is None else str(k).encode()) % HOLD_OUT == 0 for k in keys], bool)


def _tokens(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens (words, then one end mark a text) and the number of each text's tokens."""
    parts, sizes = [], []
    for _, n, h in word_hashes(texts):
        parts.append(np.insert(h, np.cumsum(n), _END))
        sizes.append(n + 1)
    return (np.concatenate(parts), np.concatenate(sizes)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


# -- totals of the training text: V and N

def _distinct(batches):
    held, n = [], 0

    def rows(h, n):
        total = np.zeros(len(h), np.int64)
        total[:1] = n
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(total)], names=["h", "n"])

    for b in batches:
        teach = pa.array(~_held(b.column("key").to_pylist()))
        tok, _ = _tokens(b.column("text").filter(teach))
        held.append(np.unique(tok))
        n += len(tok)
        if sum(map(len, held)) > 2_000_000:
            held = [np.unique(np.concatenate(held))]
            if len(held[0]) > 1_000_000:
                yield rows(held.pop(), n)
                n = 0
    if n or held:
        yield rows(np.unique(np.concatenate(held)) if held else np.zeros(0, np.uint64), n)


# -- the automaton

PIECE = 256  # tokens of a long text that are read in one go


class Automaton:
    """States are the root and every known n-gram shorter than the model's order; they share numbers with the n-grams.  The
    n-gram (h, w) is the arc from state h on token w, with weight ``arc`` and end ``target``; ``fail`` is the weight of the
    failure arc from a state to its ``suffix``.  The root has an arc for every token."""

    def __init__(self, root, depth, known, arc, target, suffix, fail):
        self.root, self.depth, self.known, self.arc, self.target, self.suffix, self.fail = root, depth, known, arc, target, suffix, fail

    def step(self, state: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weight of reading one token in each state, and the new states.  ``grams``: by depth of the state, the n-gram that
        ends with the token (that is, the arc to look for); failure arcs are followed until there is one."""
        weight, new = np.zeros(len(state)), np.full(len(state), self.root)
        todo, at = np.arange(len(state)), state
        while len(todo):
            arc = grams[self.depth[at], todo]
            found = (at == self.root) | (arc >= 0) & self.known[arc]
            hit = todo[found]
            weight[hit] += self.arc[arc[found]]
            new[hit] = self.target[arc[found]]
            todo, at = todo[~found], at[~found]
            weight[todo] += self.fail[at]
            at = self.suffix[at]
        return weight, new


# -- n-grams of a block

class Block:
    """The n-grams of a block's texts: ``unique`` (sorted hashes) and, by order, their place for each token."""

    def __init__(self, keys: list, texts, order: int):
        self.order, self.held = order, _held(keys)
        tok, self.size = _tokens(texts)
        self.first = np.append(0, np.cumsum(self.size))[:-1]
        at = np.arange(len(tok)) - np.repeat(self.first, self.size)  # place in the text
        grams, gram = [mix(tok ^ np.uint64(1))], tok
        self.valid = [np.ones(len(tok), bool)]
        for m in range(2, order + 1):
            before = np.empty_like(gram)
            before[1:] = gram[:-1]
            # m - 1 tokens before it, one of which may be the start mark
            before[at == m - 2] = _START if m == 2 else before[at == m - 2]
            gram = mix(before * _C + tok)
            self.valid.append(at >= m - 2)
            grams.append(mix(gram ^ np.uint64(m)))
        keep = [g[v] for g, v in zip(grams, self.valid)]
        self.start = mix(np.array([_START], np.uint64))
        self.unique, place = np.unique(np.concatenate([*keep, self.start]), return_inverse=True)
        teach = ~np.repeat(self.held, self.size)
        weights = np.concatenate([*(teach[v] for v in self.valid), [0]])
        self.counts = np.bincount(place, weights, len(self.unique)).astype(np.int64)
        self.counts[place[-1]] = int((~self.held).sum())  # texts that teach: the count of the start context
        self.start_place = place[-1]
        cut = np.cumsum([0, *(len(k) for k in keep)])
        self.place = []
        for v, a, b in zip(self.valid, cut, cut[1:]):
            p = np.full(len(tok), -1)
            p[v] = place[a:b]
            self.place.append(p)

    def buckets(self, n: int) -> np.ndarray:
        """Where each of n ranges of hashes begins in ``unique``."""
        edges = np.array([(k << 64) // n for k in range(1, n)], np.uint64)
        return np.concatenate([[0], np.searchsorted(self.unique, edges), [len(self.unique)]])

    def automaton(self, counts: np.ndarray, tokens: int, distinct: int, mass: float) -> Automaton:
        """The part of the model's automaton that the block's texts can reach, from the total counts of ``unique``."""
        n, root = len(self.unique), len(self.unique)
        depth, context, suffix = np.zeros(n + 1, np.int64), np.full(n + 1, root), np.full(n + 1, root)
        for m in range(1, self.order + 1):
            at = np.flatnonzero(self.valid[m - 1])
            gram = self.place[m - 1][at]
            depth[gram] = m
            if m > 1:
                suffix[gram] = self.place[m - 2][at]
                before = self.place[m - 2][at - 1]  # the gram's own context ends one token earlier
                context[gram] = np.where(np.isin(at, self.first, assume_unique=True), self.start_place, before) if m == 2 else before
        depth[self.start_place] = 1
        c = np.append(counts, 0)
        known = c > 0
        # smoothed probability of every n-gram, by rising order
        p = (c + 0.1) / (tokens + 0.1 * (distinct + 1))
        for m in range(2, self.order + 1):
            g = np.flatnonzero(depth == m)
            p[g] = (c[g] + mass * p[suffix[g]]) / (c[context[g]] + mass)
        # an arc ends in the longest known suffix that is short enough for a state
        target = np.where(depth < self.order, np.arange(n + 1), suffix)
        target = np.where(known[target], target, root)
        with np.errstate(divide="ignore"):
            return Automaton(root, depth, known, np.log10(p), target, suffix, np.log10(mass / (c + mass)))

    def read(self, counts: np.ndarray, tokens: int, distinct: int, mass: float):
        """Reads every text through the automaton, from left to right: n_known, base score, score of each text."""
        auto = self.automaton(counts, tokens, distinct, mass)
        places = np.stack(self.place)
        start = self.start_place if self.order > 1 and counts[self.start_place] > 0 else auto.root
        # long texts are read in pieces; a piece is led in by the tokens that its first state can depend on
        count = -(-self.size // PIECE)
        text = np.repeat(np.arange(len(self.size)), count)
        piece = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        begin = self.first[text] + piece * PIECE
        end = np.minimum(begin + PIECE, self.first[text] + self.size[text])
        at = np.where(piece > 0, begin - (self.order - 1), begin)
        state, total = np.where(piece > 0, auto.root, start), np.zeros(len(text))
        live = np.argsort(at - end, kind="stable")  # longest first: those still reading are in front
        left = (end - at)[live]
        for step in range(int(left[0]) if len(left) else 0):
            live = live[:np.searchsorted(-left[:len(live)], -step, "left")]
            here = at[live] + step
            got, state[live] = auto.step(state[live], places[:, here])
            total[live] += np.where(here >= begin[live], got, 0.0)
        one = self.place[0]
        add = lambda x: np.add.reduceat(x, self.first) if len(self.first) else np.zeros(0)
        score = np.bincount(text, total, len(self.size)) if len(text) else np.zeros(len(self.size))
        return add((counts[one] > 0).astype(np.int64)), add(auto.arc[one]), score


def _planes(a: np.ndarray) -> bytes:
    """Bytes of 64-bit numbers, all first bytes before all second bytes ...: similar bytes lie together for the codec."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8).T).tobytes()


def _numbers(b: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(kind).reshape(-1)


def _block(t: pa.Table, order: int) -> Block:
    return Block(t.column("key").to_pylist(), t.column("text"), order)


def _request(order: int, buckets: int):
    def run(t: pa.Table) -> pa.Table:
        b = _block(t, order)
        cut = b.buckets(buckets)
        at = [k for k in range(buckets) if cut[k] < cut[k + 1]]
        return pa.table({"bucket": pa.array(at, pa.int32()), "block": pa.array([t.column("block")[0].as_py()] * len(at), pa.int32()),
                         "grams": pa.array([_planes(b.unique[cut[k]:cut[k + 1]]) for k in at], pa.binary()),
                         "counts": pa.array([_planes(b.counts[cut[k]:cut[k + 1]]) for k in at], pa.binary())})
    return run


def _total(t: pa.Table) -> pa.Table:
    grams = [_numbers(x.as_py(), np.uint64) for x in t.column("grams")]
    counts = np.concatenate([_numbers(x.as_py(), np.int64) for x in t.column("counts")])
    unique, place = np.unique(np.concatenate(grams), return_inverse=True)
    total = np.bincount(place, counts, len(unique)).astype(np.int64)[place]
    cut = np.cumsum([0, *map(len, grams)])
    return pa.table({"block": t.column("block").cast(pa.int32()), "bucket": t.column("bucket").cast(pa.int32()),
                     "totals": pa.array([_planes(total[a:b]) for a, b in zip(cut, cut[1:])], pa.binary())})


def _score(order: int, tokens: int, distinct: int, mass: float):
    def run(docs: pa.Table, totals: pa.Table) -> pa.Table:
        b = _block(docs, order)
        got = sorted(zip(totals.column("bucket").to_pylist(), totals.column("totals").to_pylist()))
        counts = np.concatenate([_numbers(x, np.int64) for _, x in got])
        known, base, score = b.read(counts, tokens, distinct, mass)
        return pa.table({"row": docs.column("row"), "held_out": b.held, "n_tokens": b.size.astype(np.int64), "n_known": known,
                         "base_score": base, "score": score})
    return run


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER, mass: float = MASS) -> DataFrame:
    """One row per row of ``docs``: ``row`` (its other columns), held_out, n_tokens, n_known, train_tokens, base_score, score."""
    src = docs.select(F.struct(*[docs[c] for c in docs.columns if c != text]).alias("row"), docs[key].cast("string").alias("key"), docs[text].alias("text"))
    seen = src.select("key", "text").mapInArrow(_distinct, "h long, n long")
    got = seen.groupBy("h").agg(F.sum("n").alias("n")).agg(F.count("h").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).collect()[0]
    blocks = max(1, math.ceil(got.n * HOLD_OUT / (HOLD_OUT - 1) / BLOCK_TOKENS))
    dealt = src.withColumn("block", F.pmod(F.xxhash64("key", F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))
    dealt = dealt.repartition(blocks, "block")
    requests = dealt.groupBy("block").applyInArrow(_request(order, blocks), "bucket int, block int, grams binary, counts binary")
    totals = requests.repartition(blocks, "bucket").groupBy("bucket").applyInArrow(_total, "block int, bucket int, totals binary")
    totals = totals.repartition(blocks, "block")
    out = dealt.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(
        _score(order, got.n, got.v, mass),
        f"row {src.schema['row'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(got.n).cast("long"))
