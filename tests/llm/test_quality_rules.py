import random
import re

from pyspark.sql import functions as F

from kilonova.llm import queries
from kilonova.llm.quality_rules import MAX_REPEAT_PERCENT, MIN_WORDS, Rule, base_counts, learn, quality_rules

SF = "/root/testdata/sf0.01"
COLS = "doc_id long, text string, n_words string, kept int, row string, rule string"


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    count = {}
    for g in grams:
        count[g] = count.get(g, 0) + 1
    cover = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(5)}
    failed = len(w) < MIN_WORDS or 100 * len(cover) > MAX_REPEAT_PERCENT * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover), failed


def test_base_of_the_table(spark):
    got = {r.doc_id: r for r in queries.queries()["op1_quality_rules"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        r = got[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(d.text)
        assert not (r.base_failed and r.kept)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(3))
    rows, rules = quality_rules(docs.select("doc_id", "text"), labels.where(part != 0))
    assert rules
    held = rows.select("row.doc_id", "kept", "base_failed").join(labels.where(part == 0), "doc_id").where("not base_failed").collect()
    assert sum(r.kept == (r.quality == 1) for r in held) >= 0.95 * len(held) > 50


def test_odd_rows(spark):
    rnd = random.Random(2)
    words = ["a", "bé", "C!", "#", "d1"]
    texts = [None, "", " \n\t", "one", "a\n\na\n \nb\r\nb\r\n", "é" * 40_000, "ab " * 30_000, "x y z u v w\x0bx y z u v w"]
    texts += ["".join(rnd.choice(words) + rnd.choice([" ", "\n", "  ", "\x0c"]) for _ in range(rnd.randint(0, 60))) for _ in range(60)]
    rows = [(i, t, "n", 3, "r", "u") for i, t in enumerate(texts)] + [(None, "a b", None, None, None, None)] * 2
    df = spark.createDataFrame(rows, COLS)
    got = {}
    for r in base_counts(df).collect():
        got.setdefault(r.row.doc_id, []).append((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words))
    for i, t in enumerate(texts):
        assert got[i] == [brute(t)[:5]], (i, t and t[:80])
    assert got[None] == [(2, 2, 0, 0, 0)] * 2
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 0), (10, None)], "doc_id long, quality int")
    out, rules = quality_rules(df, labels)  # contradicting and null labels teach nothing
    assert rules == [] and out.count() == len(rows)
    none, rules = quality_rules(df.limit(0), labels.limit(0))
    assert rules == [] and none.count() == 0


def test_covering_orders_and_prunes(spark):
    """Two kinds of bad rows, one of them found only by a conjunction."""
    rnd = random.Random(4)
    zero = dict.fromkeys(("mark_ratio", "digit_ratio", "word_length", "dup_line_ratio", "repeat_ratio", "distinct_ratio"), 0.5)
    rows = []
    for _ in range(1200):
        s, u = rnd.random(), rnd.random()
        rows.append({**zero, "symbol_ratio": s, "upper_ratio": u, "bad": s > 0.8 or (0.3 < s < 0.6 and u > 0.7), "hold": rnd.random() < 0.3})
    df = spark.createDataFrame(rows)
    rules = learn(df)
    assert 2 <= len(rules) <= 8 and all(isinstance(r, Rule) for r in rules)
    hit = " or ".join(f"({r.sql()})" for r in rules)
    assert df.where(f"bad <> ({hit})").count() < 0.08 * len(rows)
    assert any(len(r.literals) > 1 for r in rules)
