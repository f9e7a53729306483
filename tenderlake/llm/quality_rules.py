"""Learned quality rules: a decision list from labelled statistics (native).

Every text is reduced to a row of statistics by SQL functions.  On the rows
with a quality label, sequential covering learns an ordered list of rules that
reject: a rule is grown literal by literal (``feature <= t`` or
``feature > t``) by information gain on two thirds of the rows, pruned from
its end on the other third, and the rows it covers leave the pool.  Each step
is one aggregate over the compact statistics table that returns counts per
(feature, threshold bin, label): the driver sees a few hundred counts,
whatever the number of rows.  The list is emitted as one ordered Spark
conditional expression, readable and without Python at scoring time.

Defined cases: a null text is empty (no words); without labelled rows of both
kinds the list is empty and keeps everything; labels may repeat (each row
counts) or be null (ignored); repeated rows are scored each; further columns
are carried.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake.llm.common import let, saved, text_or_empty, word_array

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8               # words in a repeated window
BINS = 32                # threshold candidates per feature
MAX_RULES, MAX_LITERALS = 8, 3
MIN_COVER, MIN_PRECISION = 20, 0.7


# ---------------------------------------------------------------- statistics

def repeated_words(words: Column) -> Column:
    """Words that lie in an 8-word window found twice or more in the text.

    Windows are compared by a 64-bit hash; duplicates are found by sorting
    (hash, position), the union of covered positions by sorting positions."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(hashes, lambda h: F.transform(
        F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, F.lit(WINDOW)))))

    def covered(w: Column) -> Column:
        order = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

        def twice(s: Column) -> Column:
            near = lambda e, j: F.coalesce(F.get(s, j)["h"] == e["h"], F.lit(False))
            return F.filter(F.transform(s, lambda e, i: F.when(near(e, i - 1) | near(e, i + 1), e["p"])),
                            lambda p: p.isNotNull())
        return let(F.sort_array(let(order, twice)), lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))),
            F.lit(0), lambda a, x: a + x))

    counted = let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w)))
    return F.when(F.size(words) >= WINDOW, counted).otherwise(F.lit(0)).cast("long")


def statistics(text: Column) -> Column:
    """Struct of the text's statistics, all long."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    count = lambda p: F.regexp_count(text, F.lit(p)).cast("long")
    of_words = let(word_array(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
        repeated_words(w).alias("n_repeat_words")))
    dup = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    return F.struct(of_words.alias("w"), count(SYMBOLS).alias("n_symbols"), dup.alias("n_dup_lines"),
                    count("[A-Z]").alias("n_upper"), count("[0-9]").alias("n_digits"),
                    count("[.!?]").alias("n_stops"), count("!").alias("n_bangs"))


def features(s: dict[str, Column]) -> dict[str, Column]:
    """Rates per thousand from the statistics; 0 where there are no words."""
    per = lambda a, b: F.when(b > 0, F.floor(1000 * a / b)).otherwise(F.lit(0)).cast("long")
    return {
        "words": s["n_words"],
        "word_length": per(s["word_chars"], s["n_words"]),
        "symbol_rate": per(s["n_symbols"], s["word_chars"]),
        "dup_lines": s["n_dup_lines"],
        "repeat_rate": per(s["n_repeat_words"], s["n_words"]),
        "distinct_rate": per(s["n_distinct"], s["n_words"]),
        "upper_rate": per(s["n_upper"], s["word_chars"]),
        "digit_rate": per(s["n_digits"], s["word_chars"]),
        "stop_rate": per(s["n_stops"], s["n_words"]),
        "bang_rate": per(s["n_bangs"], s["n_words"]),
    }


STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_upper",
         "n_digits", "n_stops", "n_bangs")


def with_statistics(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the statistics of every whole text, one row per row."""
    got = docs.select(*keep, statistics(text_or_empty(text_col)).alias("_s"))
    return got.select(*keep, *[F.col(f"_s.w.{c}" if c in ("n_words", "word_chars", "n_distinct", "n_repeat_words")
                                     else f"_s.{c}").alias(c) for c in STATS])


# ------------------------------------------------------------------ learning

@dataclass
class Literal:
    feature: str
    above: bool
    threshold: int

    def column(self, f: dict[str, Column]) -> Column:
        x = f[self.feature]
        return x > self.threshold if self.above else x <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold}"


@dataclass
class Rule:
    literals: list[Literal] = field(default_factory=list)
    bad: int = 0
    good: int = 0

    def column(self, f: dict[str, Column]) -> Column:
        out = F.lit(True)
        for x in self.literals:
            out = out & x.column(f)
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.literals)) + f"  [{self.bad} bad, {self.good} good]"


def decision(rules: list[Rule], f: dict[str, Column]) -> Column:
    """Number of the first rule that holds (1-based), 0 if none: the ordered
    conditional expression of the list."""
    out = F
    for i, r in enumerate(rules):
        out = out.when(r.column(f), F.lit(i + 1))
    return out.otherwise(F.lit(0)) if rules else F.lit(0)


def learn(stats: DataFrame, label: str = "quality", row_key: str = "doc_id", max_rules: int = MAX_RULES,
          max_literals: int = MAX_LITERALS, min_cover: int = MIN_COVER,
          min_precision: float = MIN_PRECISION) -> list[Rule]:
    """Rules that reject, learned on the rows of ``stats`` with a label (1
    good, 0 bad)."""
    exprs = features({c: F.col(c) for c in STATS})
    names = list(exprs)
    pool = stats.where(F.col(label).isin(0, 1)).select(
        (F.col(label) == 0).alias("bad"), (F.pmod(F.xxhash64(F.lit(7), row_key), F.lit(3)) != 0).alias("grow"),
        *[e.alias(n) for n, e in exprs.items()])
    steps = [i / BINS for i in range(1, BINS)]
    row = pool.agg(*[F.percentile_approx(n, steps, 1000).alias(n) for n in names]).first()
    cuts = {n: sorted(set(row[n])) if row and row[n] else [] for n in names}
    # the bin of a value: how many thresholds it is above
    def bin_of(n: str) -> Column:
        return sum((F.when(F.col(n) > int(c), 1).otherwise(0) for c in cuts[n]), F.lit(0))

    binned = saved(pool.select("bad", "grow", F.array(*map(bin_of, names)).alias("bins")), "rules-bins").cache()

    def holds(rule: list[tuple[int, bool, int]]) -> Column:
        out = F.lit(True)
        for f, above, b in rule:
            x = F.get("bins", F.lit(f))
            out = out & ((x > b) if above else (x <= b))
        return out

    rules, gone = [], F.lit(False)
    for _ in range(max_rules):
        left = binned.where(~gone)
        literals: list[tuple[int, bool, int]] = []
        while len(literals) < max_literals:
            got = (left.where("grow").where(holds(literals)).select("bad", F.posexplode("bins").alias("f", "b"))
                   .groupBy("f", "b", "bad").count().collect())
            table = [[[0, 0] for _ in range(len(cuts[n]) + 1)] for n in names]
            for r in got:
                table[r["f"]][r["b"]][0 if r["bad"] else 1] += r["count"]
            best = _best_literal(table, min_cover)
            if best is None:
                break
            literals.append(best[0])
            if best[1][1] == 0:
                break
        if not literals:
            break
        # prune from the end on the rows kept apart
        cols = [F.count_if(holds(literals[:k]) & (F.col("bad") == b)).alias(f"{'b' if b else 'g'}{k}")
                for k in range(1, len(literals) + 1) for b in (True, False)]
        r = left.where(~F.col("grow")).agg(*cols).first()
        worth = [((r[f"b{k}"] - r[f"g{k}"]) / (r[f"b{k}"] + r[f"g{k}"] + 1.0), -k)
                 for k in range(1, len(literals) + 1)]
        k = -max(worth)[1]
        bad, good = r[f"b{k}"], r[f"g{k}"]
        if bad < min_cover / 4 or bad < min_precision * (bad + good):
            break
        literals = literals[:k]
        rules.append(Rule([Literal(names[f], a, int(cuts[names[f]][b])) for f, a, b in literals], bad, good))
        gone = gone | holds(literals)
    binned.unpersist()
    return rules


def _best_literal(table, min_cover):
    """The literal with the highest information gain times bad rows covered:
    bin <= b means value <= cuts[b]."""
    bad0, good0 = (sum(x[i] for x in table[0]) for i in (0, 1))
    if bad0 < min_cover or good0 == 0:
        return None
    base, best = math.log2(bad0 / (bad0 + good0)), None
    for f, bins in enumerate(table):
        bad = good = 0
        for b, (x, y) in enumerate(bins[:-1]):
            bad, good = bad + x, good + y
            for above, p, n in ((False, bad, good), (True, bad0 - bad, good0 - good)):
                if p >= min_cover and (p, n) != (bad0, good0):
                    gain = p * (math.log2(p / (p + n)) - base)
                    if gain > 0 and (best is None or gain > best[2]):
                        best = ((f, above, b), (p, n), gain)
    return best


def judge(stats: DataFrame, rules: list[Rule], base: Column) -> DataFrame:
    """``stats`` with ``base_failed``, ``rule`` (0: none) and ``kept``."""
    f = features({c: F.col(c) for c in STATS})
    return (stats.withColumn("base_failed", base).withColumn("rule", decision(rules, f).cast("int"))
            .withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)))


def base_rule() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
