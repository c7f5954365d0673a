"""Operator 1: quality rules as a learned decision list.

Per text, DataFrame functions alone give counts (words, characters, symbols, repeated lines and words) and ratios.  From
the labelled rows, sequential covering learns an ordered list of rules, each a conjunction of thresholds on ratios that
marks bad texts: a rule grows by the literal of greatest information gain, is pruned from its end while that does not
lower its worth on the labelled rows kept apart for pruning, and leaves the rows that it covers to the next rules.  All that learning reads are
histograms (literal x bin x label), counted by Spark; the driver sees a number of cells that is fixed by the
parameters.  The list is emitted as one ordered conditional expression.

Null, empty and wordless texts have zero counts and fail the base rule.  Rows without a label, or with contradicting
labels, teach nothing.  A repeated row gets the same result each time and teaches once for each time.  Without both
labels the list is empty and the base rule alone decides.
"""
from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, written

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

#: ratios that literals compare: independent of a text's length
RATIOS = {
    "symbol_ratio": "n_symbols / n_words",
    "mark_ratio": "n_marks / n_words",
    "upper_ratio": "n_upper / greatest(word_chars, 1)",
    "digit_ratio": "n_digits / greatest(word_chars, 1)",
    "word_length": "word_chars / n_words",
    "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_ratio": "n_repeat_words / n_words",
    "distinct_ratio": "n_distinct / n_words",
}


@dataclass(frozen=True)
class Params:
    """Production parameters of the learner."""

    bins: int = 32  # thresholds of a ratio: its approximate quantiles
    max_rules: int = 8
    max_literals: int = 3
    min_covered: int = 5  # labelled bad rows that a rule must cover while growing
    min_precision: float = 0.9  # share of bad rows among those that a rule covers when pruning
    prune_share: float = 1 / 3  # of the labelled rows, kept for pruning


@dataclass
class Rule:
    literals: list[tuple[str, str, float]] = field(default_factory=list)  # (ratio, ">=" or "<", threshold)

    def sql(self) -> str:
        return " AND ".join(f"{f} {op} {t!r}D" for f, op, t in self.literals) or "true"


def base_counts(docs: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``row`` (all columns of ``docs``, the text only if asked for) and the counts of each whole text."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉÈÊÀÂÇÑÁÍÓÚ"
    count_of = lambda chars: F.char_length("t") - F.char_length(F.translate("t", chars, ""))
    rest = [docs[c] for c in docs.columns if keep_text or c != text]
    d = docs.select(F.struct(*rest).alias("row"), F.coalesce(docs[text], F.lit("")).alias("t"))
    blank = F.translate("t", SPACES, " " * len(SPACES))
    d = d.select(
        "row", F.array_remove(F.split(blank, " "), "").alias("w"),
        F.expr(r"filter(split(t, '\n'), x -> translate(x, ' \t\n\u000b\f\r', '') <> '')").alias("lines"),
        F.char_length(F.translate("t", SPACES, "")).alias("word_chars"), count_of(SYMBOLS).alias("n_symbols"),
        count_of("!?").alias("n_marks"), count_of(upper).alias("n_upper"), count_of("0123456789").alias("n_digits"))
    windows = ("case when size(w) < 5 then cast(array() as array<bigint>) else "
               "transform(sequence(0, size(w) - 5), i -> xxhash64(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4])) end")
    d = d.select("*", F.expr(windows).alias("g")).select(
        "row", "word_chars", "n_symbols", "n_marks", "n_upper", "n_digits", F.size("w").cast("long").alias("n_words"),
        F.size(F.array_distinct("w")).alias("n_distinct"), F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        # windows found twice or more, as sorted places; the words that they cover are a union of intervals of five
        F.expr("""case when size(g) = size(array_distinct(g)) then cast(array() as array<int>) else
            (select_places(g)) end""".replace("(select_places(g))", _REPEATED)).alias("at"))
    covered = "aggregate(at, named_struct('n', 0L, 'to', 0), (a, p) -> named_struct('n', a.n + p + 5 - greatest(p, a.to), 'to', p + 5), a -> a.n)"
    d = d.withColumn("n_repeat_words", F.expr(covered))
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_marks", "n_upper", "n_digits", "n_distinct", "n_lines"]
    return d.select("row", *[F.col(c).cast("long").alias(c) for c in longs])


#: places (sorted) of the windows ``g`` that occur more than once: sort (hash, place), keep those with an equal neighbour
_REPEATED = """sort_array(transform(filter(
    transform(array(sort_array(transform(g, (h, i) -> named_struct('h', h, 'i', i)))), s ->
      transform(s, (x, k) -> named_struct('i', x.i, 'twice',
        (k > 0 and s[greatest(k - 1, 0)].h = x.h) or (k < size(s) - 1 and s[least(k + 1, size(s) - 1)].h = x.h))))[0],
    x -> x.twice), x -> x.i))"""


def with_ratios(counts: DataFrame) -> DataFrame:
    fine = F.col("n_words") > 0
    return counts.select("*", *[F.when(fine, F.expr(e)).otherwise(F.lit(0.0)).cast("double").alias(n) for n, e in RATIOS.items()])


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    """Information gained on p bad rows by narrowing (p0, n0) to (p, n)."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p and p0 else 0.0


def learn(labelled: DataFrame, params: Params = Params()) -> list[Rule]:
    """Ordered rules from rows with the ratios, ``bad`` (boolean) and ``hold`` (boolean: kept for pruning)."""
    names = list(RATIOS)
    probs = [i / (params.bins + 1) for i in range(1, params.bins + 1)]
    cuts = labelled.groupBy("bad").agg(*[F.percentile_approx(n, probs, 10_000).alias(n) for n in names]).collect()
    grid = {n: sorted({float(x) for r in cuts for x in r[n] or []}) for n in names}
    bin_of = {n: F.expr(f"size(filter(array({', '.join(f'{t!r}D' for t in grid[n])}), t -> t <= {n}))") if grid[n] else F.lit(0) for n in names}
    binned = labelled.select("bad", "hold", *names, F.array(*[bin_of[n] for n in names]).alias("bins"))
    found: list[Rule] = []
    # what no rule covers yet; each pass below counts this with one more condition
    left = "true"
    for _ in range(params.max_rules):
        rule, here = Rule(), None
        while len(rule.literals) < params.max_literals:
            cells = (binned.where(f"not hold and {left} and {rule.sql()}").select("bad", F.posexplode("bins").alias("f", "b"))
                     .groupBy("f", "b", "bad").count().collect())
            total = {x: sum(c["count"] for c in cells if c.f == 0 and c.bad == x) for x in (True, False)}
            if here is None and total[True] < params.min_covered or not total[False]:
                break
            best = None
            for f, name in enumerate(names):
                for k in range(1, len(grid[name]) + 1):
                    for op in (">=", "<"):
                        p, n = (sum(c["count"] for c in cells if c.f == f and c.bad == x and (c.b >= k) == (op == ">=")) for x in (True, False))
                        if p >= params.min_covered:
                            g = _gain(p, n, total[True], total[False])
                            if g > 1e-9 and (best is None or g > best[0]):
                                best = (g, (name, op, grid[name][k - 1]))
            if best is None:
                break
            rule.literals.append(best[1])
            here = total
        if not rule.literals:
            break
        rule = _prune(binned, left, rule)
        p, n = _covered(binned, left, [rule])[0]
        if p < params.min_covered or p < params.min_precision * (p + n):
            break
        found.append(rule)
        left += f" AND NOT ({rule.sql()})"
    return found


def _covered(rows: DataFrame, left: str, rules: list[Rule], where: str = "true") -> list[tuple[int, int]]:
    aggs = [F.expr(f"count_if({'' if bad else 'not '}bad and {r.sql()})") for r in rules for bad in (True, False)]
    got = rows.where(f"{left} and {where}").agg(*aggs).collect()[0]
    return [(got[2 * i], got[2 * i + 1]) for i in range(len(rules))]


def _prune(rows: DataFrame, left: str, rule: Rule) -> Rule:
    """The beginning of the rule with the greatest (bad - good) / (bad + good) on the pruning rows; longer on a tie."""
    heads = [Rule(rule.literals[:k]) for k in range(1, len(rule.literals) + 1)]
    worth = [((p - n) / (p + n) if p + n else -1.0) for p, n in _covered(rows, left, heads, "hold")]
    return heads[max(range(len(heads)), key=lambda k: (worth[k], k))]


def decision(rules: list[Rule]) -> Column:
    """Index of the first rule that fits, or null: the ordered conditional expression."""
    if not rules:
        return F.lit(None).cast("int")
    return F.expr("case " + " ".join(f"when {r.sql()} then {i}" for i, r in enumerate(rules)) + " end")


def quality_rules(docs: DataFrame, labels: DataFrame, params: Params = Params(), key: str = "doc_id", label: str = "quality",
                  keep_text: bool = False) -> tuple[DataFrame, list[Rule]]:
    """(One row per row of ``docs`` -- ``row`` with its other columns, counts, ratios, base_failed, rule, kept; the learned rules).
    ``labels``: key and label (1 good, 0 bad)."""
    rows = written(with_ratios(base_counts(docs, keep_text=keep_text)).withColumn("base_failed", base_failed()), "quality-ratios")
    one = (labels.where(f"{key} is not null and {label} is not null").groupBy(key)
           .agg(F.min(label).alias("lo"), F.max(label).alias("hi")).where("lo = hi").select(F.col(key).alias("k"), (F.col("lo") == 0).alias("bad")))
    hold = F.pmod(F.xxhash64("k", F.lit(11)), F.lit(1000)) < int(1000 * params.prune_share)
    taught = rows.where("not base_failed").select(F.col(f"row.{key}").alias("k"), *RATIOS).join(one, "k").select("bad", hold.alias("hold"), *RATIOS)
    rules = learn(written(taught, "quality-labelled"), params)
    out = rows.withColumn("rule", decision(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()), rules
