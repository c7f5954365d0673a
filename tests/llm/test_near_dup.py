import random
import re
from collections import defaultdict

import numpy as np
import pytest

from kilonova.llm import near_dup, queries

COLS = "doc_id long, text string, component_id string, row string, kept int"


def shingle_set(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows, percent=85):
    """Components of the exact join (candidates by shared shingles), as {row number: (size, component)}."""
    sets = [shingle_set(t) for _, t in rows]
    at = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            at[x].append(i)
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in enumerate(sets):
        if rows[i][0] is None:
            continue
        for j in {j for x in s for j in at[x] if j < i and rows[j][0] is not None}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(sets[i]), least[root(i)] if d is not None else None) for i, (d, _) in enumerate(rows)), key=str)


def result(df):
    got = near_dup.near_duplicates(df).collect()
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_exact_join(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()]
    got = queries.queries()["op5_near_duplicates"](spark, f"/root/testdata/{sf}").collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(docs)


def group(rnd, base, n, edits, first):
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rnd.randint(0, edits)):
            w[rnd.randrange(len(w))] = f"e{rnd.random()}"
        rows.append((first + i, " ".join(w)))
    return rows


def test_large_groups_over_many_blocks(spark, monkeypatch):
    """A bucket of near copies on both sides of the threshold, cut into many blocks."""
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    rnd = random.Random(8)
    rows = group(rnd, [f"w{i}" for i in range(150)], 220, 7, 1000)
    rows += group(rnd, [f"v{i}" for i in range(60)], 60, 2, 3000)
    rows += [(5000 + i, rows[0][1]) for i in range(150)]  # exact copies
    rnd.shuffle(rows)
    df = spark.createDataFrame([(d, t, "c", "r", 1) for d, t in rows], COLS)
    assert result(df) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b c"), (5, "A  B\tc"), (6, "a b"), (7, "a b c d e"), (8, "a b c d e"), (8, "a b c d e"), (None, "a b c d e"),
            (None, None), (9, "é É é É é É"), (10, "x " * 50_000), (11, "x " * 40_000), (12, "p q r s t u"), (12, "other words are in this one"), (3, "p q r s t u")]
    df = spark.createDataFrame([(d, t, "c", "r", 1) for d, t in rows], COLS)
    assert result(df) == brute(rows)
    assert near_dup.near_duplicates(df.limit(0)).count() == 0
    kept = near_dup.keep_one(df).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id) == [1, 2, 3, 3, 4, 6, 7, 9, 10, 12] and sum(r.doc_id is None for r in kept) == 2
    assert kept[0].__fields__ == ["doc_id", "text", "component_id", "row", "kept"]


def test_components_of_a_long_chain(spark):
    rnd = random.Random(3)
    names = rnd.sample(range(10_000), 300)
    links = list(zip(names, names[1:])) + [(20_000, 20_001), (20_001, 20_000), (5_000_000, 5_000_000)]
    got = {r.node: r.root for r in near_dup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[n] for n in names} == {got[names[0]]} and got[20_000] == got[20_001] != got[names[0]] and len(got) == 302


def test_pruning_keeps_what_reaches_the_threshold():
    rules = near_dup.least_matches()
    rng = np.random.default_rng(0)
    m = rng.random((200_000, near_dup.ROWS * near_dup.BANDS)) < 0.85
    lost = np.zeros(len(m), bool)
    for n, least in rules:
        lost |= m[:, :n].sum(1) < least
    assert lost.mean() < 1e-4 and rules[0][1] > 4


def test_another_threshold_has_bands_of_its_own():
    assert near_dup.bands() == near_dup.bands(85) == (near_dup.ROWS, near_dup.BANDS)
    rng = np.random.default_rng(4)
    minima = rng.integers(0, 1 << 60, (50_000, near_dup.ROWS * near_dup.BANDS), dtype=np.uint64)
    other = np.where(rng.random(minima.shape) < 0.8, minima, minima + np.uint64(1))  # pairs at 0.8
    missed = ~(near_dup.band_keys(minima, percent=80) == near_dup.band_keys(other, percent=80)).any(1)
    assert missed.mean() < 1e-4  # bands of 85: 7e-4


def test_another_threshold_equals_exact_join(spark):
    """Pairs between 0.80 and 0.85 are linked at 80 only."""
    rows, rnd = [], random.Random(6)
    for i in range(60):
        base = [f"b{i}_{k}" for k in range(rnd.randint(56, 110))]
        other = list(base)
        for k in rnd.sample(range(5, len(base) - 5), 2):
            other[k] = f"o{i}_{k}"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
    assert brute(rows, 80) != brute(rows, 85)
    df = spark.createDataFrame([(d, t, "c", "r", 1) for d, t in rows], COLS)
    for percent in (80, 85):
        got = near_dup.near_duplicates(df, percent=percent).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, percent)
        assert sorted(r.doc_id for r in near_dup.keep_one(df, percent=percent).collect()) == sorted({c for _, _, c in brute(rows, percent)})
