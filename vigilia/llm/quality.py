"""Quality rules: text statistics and a decision list learned from labelled ones.

Everything that touches a text is a built-in Spark expression. Sequential
covering runs on the driver over the statistics (a dozen numbers a row) of a
bounded sample of labelled rows: a rule grows by the threshold test with the
best FOIL gain on two thirds of them, is pruned from its end on the other
third, and joins the list while it is precise there. The list is emitted as
one ordered conditional expression.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilia.llm.common import lowest

#: Fixed values of the contract: what separates words, what counts as a symbol.
GAP = r"[\x20\x09-\x0D]"
NOT_GAP = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8

#: Names of the statistics that rules test.
FEATURES = ("n_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "bang_share", "digit_share", "line_length")

LABELLED_ROWS = 20_000
MAX_RULES, MAX_TESTS, CUTS = 12, 3, 48
PRECISION, SUPPORT = 0.9, 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value which is computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words inside windows of `width` words that occur at least twice in the row's words, the first occurrence included.

    Windows are compared by a 64-bit hash. Rows without a repeat, found by
    counting distinct hashes, go no further; in others a sort brings equal
    windows together, and the covered words are the lengths of the union of
    the repeated windows. No step is quadratic in the length of the text.
    """

    def windows(hashes: Column) -> Column:
        last = F.size(hashes) - width
        run = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*(F.get(hashes, i + j) for j in range(width))))
        return F.when(last >= 0, run).otherwise(F.array().cast("array<bigint>"))

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(at, k + 1) - x, F.lit(width)))), F.lit(0), lambda a, x: a + x)

    def repeats(order: Column) -> Column:
        twice = F.filter(order, lambda e, k: (F.get(order, k - 1)["h"] == e["h"]) | (F.get(order, k + 1)["h"] == e["h"]))
        return F.sort_array(F.transform(twice, lambda e: e["i"]))

    def count(h: Column) -> Column:
        order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(let(order, repeats), covered))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.coalesce(let(let(hashes, windows), count), F.lit(0))


def with_statistics(docs: DataFrame, text: str) -> DataFrame:
    """Add the contract's counts and FEATURES; a null text is empty, and shares of nothing are 0."""
    body = F.coalesce(F.col(text), F.lit(""))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    count = lambda pattern: F.regexp_count("_body", F.lit(pattern))
    out = docs.withColumn("_body", body)
    out = out.withColumns({
        "_words": F.filter(F.split("_body", GAP + "+"), lambda w: w != ""),
        "_lines": F.filter(F.split("_body", "\n"), lambda x: x.rlike(NOT_GAP)),
        "word_chars": (F.length("_body") - count(GAP)).cast("long"),
        "n_symbols": count(SYMBOLS).cast("long"),
        "_upper": count("[A-Z]"), "_bang": count("!"), "_digit": count("[0-9]"),
    })
    out = out.withColumns({
        "n_words": F.size("_words").cast("long"), "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": repeated_words(F.col("_words")).cast("long"),
    })
    words, chars = F.col("n_words"), F.col("word_chars")
    return out.withColumns({
        "word_length": share(chars, words), "symbol_share": share(F.col("n_symbols"), words), "dup_line_share": share(F.col("n_dup_lines"), F.col("n_lines")),
        "repeat_share": share(F.col("n_repeat_words"), words), "upper_share": share(F.col("_upper"), chars), "bang_share": share(F.col("_bang"), words),
        "digit_share": share(F.col("_digit"), chars), "line_length": share(words, F.col("n_lines")),
    })


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    cut: float

    def rows(self, table: dict[str, np.ndarray]) -> np.ndarray:
        return table[self.feature] >= self.cut if self.above else table[self.feature] < self.cut

    def column(self) -> Column:
        return F.col(self.feature) >= F.lit(self.cut) if self.above else F.col(self.feature) < F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.cut:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Rules tried in order; a row is rejected by the first whose tests all hold and kept if there is none."""

    rules: tuple[tuple[Test, ...], ...]

    def fired(self) -> Column:
        """The number of the rule that rejects a row, from 1; 0 if none does."""
        out = F.lit(0)
        for k, rule in reversed(list(enumerate(self.rules, 1))):
            test = rule[0].column()
            for more in rule[1:]:
                test = test & more.column()
            out = F.when(test, F.lit(k)).otherwise(out)
        return out

    def __str__(self) -> str:
        return "\n".join(["if " + " and ".join(map(str, r)) + ": reject" for r in self.rules] + ["keep"])


def _holds(rule, table, n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for test in rule:
        out &= test.rows(table)
    return out


def _grow(table: dict[str, np.ndarray], bad: np.ndarray, left: np.ndarray) -> list[Test]:
    rule, here = [], left.copy()
    while len(rule) < MAX_TESTS:
        p0, n0 = int((here & bad).sum()), int((here & ~bad).sum())
        if not p0 or not n0:
            break
        base, best = np.log2(p0 / (p0 + n0)), (1e-9, None)
        for feature, values in table.items():
            own = values[here]
            cuts = np.unique(np.quantile(own, np.linspace(0, 1, CUTS + 1)[1:-1]))
            wrong = np.sort(own[bad[here]])
            right = np.sort(own[~bad[here]])
            below_p, below_n = np.searchsorted(wrong, cuts), np.searchsorted(right, cuts)
            for above, p, n in ((True, p0 - below_p, n0 - below_n), (False, below_p, below_n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p >= SUPPORT, p * (np.log2(np.maximum(p, 1) / np.maximum(p + n, 1)) - base), 0)
                k = int(np.argmax(gain)) if len(gain) else 0
                if len(gain) and gain[k] > best[0]:
                    best = (float(gain[k]), Test(feature, above, float(cuts[k])))
        if best[1] is None:
            break
        rule.append(best[1])
        here &= best[1].rows(table)
    return rule


def learn_list(table: dict[str, np.ndarray], bad: np.ndarray) -> DecisionList:
    """Sequential covering of the rows marked bad. Rows are split for growing and pruning by their place."""
    n = len(bad)
    prune = np.arange(n) % 3 == 2
    left, rules = np.ones(n, bool), []
    while len(rules) < MAX_RULES:
        rule = _grow(table, bad, left & ~prune)
        if not rule:
            break

        def worth(r):
            on = _holds(r, table, n) & left & prune
            p, q = int((on & bad).sum()), int((on & ~bad).sum())
            return (p - q) / (p + q) if p + q else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule.pop()
        on = _holds(rule, table, n) & left
        if (on & bad).sum() < SUPPORT or (on & bad).sum() < PRECISION * on.sum() or worth(rule) < 2 * PRECISION - 1:
            break
        rules.append(tuple(rule))
        left &= ~on
    return DecisionList(tuple(rules))


def fit_rules(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, bound: int = LABELLED_ROWS) -> DecisionList:
    """Learn from the statistics of at most `bound` labelled rows, those whose keys hash lowest; label 0 is bad.

    Rows without a label or key are passed over; without any labelled rows the
    list is empty and keeps everything.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(label).alias("_label"))
    chosen = lowest(known, "_key", bound)
    slim = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_key")  # `bound` rows at most
    rows = with_statistics(slim, "_text").select("_key", "_label", *FEATURES).orderBy(F.xxhash64("_key"), "_key").limit(bound).collect()
    table = {f: np.array([r[f] for r in rows], float) for f in FEATURES}
    return learn_list(table, np.array([r["_label"] == 0 for r in rows], bool)) if rows else DecisionList(())


def judge(docs: DataFrame, rules: DecisionList, key: str, text: str) -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule) of every row.

    Null and empty texts have no words and fail the base; long texts are judged
    whole; each row stands for itself, also one that repeats or has a null key.
    Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (
        with_statistics(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_text").withColumn("rule", rules.fired())
        .select(F.col("_key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("rule") == 0)).alias("kept"), "rule")
    )
