"""Quality rules as a learned decision list, run as Spark conditional expressions.

Statistics of a text are plain column expressions.  Sequential covering learns
an ordered list of rules from labelled statistics: each rule is a conjunction
of thresholds, grown on two thirds of the labelled rows by information gain and
pruned on the rest; rows it covers are then set aside.  The list comes out as
one ``CASE WHEN`` expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from contactweave.llm.common import SPACES
from contactweave.plans.lookups import fits_broadcast

LABELLED = 20_000  # most labelled rows the list is learned from
_SPACE = r"[\x20\x09-\x0D]+"
_WINDOW = 8
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated(words: Column) -> Column:
    """Number of words in windows of eight that occur twice or more."""

    def of_hashes(h: Column) -> Column:
        # windows sorted by hash: equal neighbours are repeats; their places, in order, cover words
        def places(s: Column) -> Column:
            return F.filter(
                F.sequence(F.lit(0), F.size(s) - 1),
                lambda i: ((i > 0) & (F.get(s, i - 1)["h"] == F.get(s, i)["h"]))
                | ((i < F.size(s) - 1) & (F.get(s, i + 1)["h"] == F.get(s, i)["h"])),
            )

        def starts(s: Column) -> Column:
            return F.sort_array(F.transform(places(s), lambda i: F.get(s, i)["at"]))

        def covered(p: Column) -> Column:
            gaps = F.transform(
                p, lambda at, i: F.when(i < F.size(p) - 1, F.least(F.lit(_WINDOW), F.get(p, i + 1) - at)).otherwise(_WINDOW)
            )
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), _let(ordered, lambda s: _let(starts(s), covered))).otherwise(F.lit(0).cast("long"))

    def of_words(w: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), F.size(w) - _WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(_WINDOW)])
        )
        return F.when(F.size(w) > _WINDOW, _let(windows, of_hashes)).otherwise(F.lit(0).cast("long"))

    return _let(F.transform(words, lambda x: F.xxhash64(x)), of_words)


def statistics(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the base counts and the learned list's features of every text; a null text has no words.

    Every row gives one row, whatever its doc_id.  Columns in ``carry`` come along.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACES))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text.alias("text"),
        F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, _SPACE)).alias("words"),
        *carry,
    )
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return rows.select(
        "doc_id",
        *carry,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", _SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("words")).alias("n_repeat_words"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.length(F.regexp_replace("text", r"[^A-Z]+", "")).cast("long").alias("n_capitals"),
        F.length(F.regexp_replace("text", r"[^!?]+", "")).cast("long").alias("n_shouts"),
        F.length(F.regexp_replace("text", r"[^0-9]+", "")).cast("long").alias("n_digits"),
        F.length(F.regexp_replace("text", "[^\n]+", "")).cast("long").alias("n_lines"),
    )


def features() -> dict[str, Column]:
    """Ratios the rules may test, all over the statistics."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return {
        "words": F.col("n_words").cast("double"),
        "mean_word": F.col("word_chars") / words,
        "symbols": F.col("n_symbols") / words,
        "dup_lines": F.col("n_dup_lines") / (F.col("n_lines") + 1),
        "repeats": F.col("n_repeat_words") / words,
        "variety": F.col("n_distinct") / F.sqrt(words),
        "capitals": F.col("n_capitals") / chars,
        "shouts": F.col("n_shouts") / words,
        "digits": F.col("n_digits") / chars,
        "lines": F.col("n_lines") / words,
    }


def repetitive() -> Column:
    return 100 * F.col("n_repeat_words") > 30 * F.col("n_words")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | repetitive()


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float


@dataclass(frozen=True)
class Rule:
    """If all tests hold, the text is kept or not.  covered and right are counts on the labelled rows it was grown on."""

    tests: tuple[Test, ...]
    keep: bool
    covered: int = 0
    right: int = 0


def _holds(tests, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for t in tests:
        out &= x[t.feature] > t.threshold if t.above else x[t.feature] <= t.threshold
    return out


def _entropy_gain(pos: np.ndarray, neg: np.ndarray, p0: float, n0: float) -> np.ndarray:
    """FOIL's gain: covered targets times what the test adds to their purity in bits."""
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = pos * (np.log2(pos / (pos + neg)) - np.log2(p0 / (p0 + n0)))
    return np.where(pos > 0, gain, -np.inf)


def _grow(x: dict[str, np.ndarray], target: np.ndarray, most_tests: int) -> tuple[Test, ...]:
    tests: list[Test] = []
    inside = np.ones(len(target), bool)
    while len(tests) < most_tests:
        y = target[inside]
        p0, n0 = float(y.sum()), float((~y).sum())
        if not p0 or not n0:
            break
        best = (1e-9, None)
        for name, column in x.items():
            v = column[inside]
            order = np.argsort(v, kind="stable")
            v, hit = v[order], y[order]
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            pos = np.cumsum(hit)[cut].astype(float)
            neg = cut + 1 - pos
            for above, p, n in ((False, pos, neg), (True, p0 - pos, n0 - neg)):
                gain = _entropy_gain(p, n, p0, n0)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], Test(name, above, float((v[cut[k]] + v[cut[k] + 1]) / 2)))
        if best[1] is None:
            break
        tests.append(best[1])
        inside &= _holds([best[1]], x, len(target))
    return tuple(tests)


def _worth(tests, x: dict[str, np.ndarray], target: np.ndarray) -> float:
    inside = _holds(tests, x, len(target))
    p, n = float(target[inside].sum()), float((~target[inside]).sum())
    return (p - n) / (p + n) if p + n else -1.0


def _prune(tests, x: dict[str, np.ndarray], target: np.ndarray) -> tuple[Test, ...]:
    """Drops last tests, and then any one test, while the held-back rows like it no less."""
    while len(tests) > 1:
        shorter = [tests[:-1], *[tests[:k] + tests[k + 1 :] for k in range(len(tests) - 1)]]
        best = max(shorter, key=lambda t: _worth(t, x, target))
        if _worth(best, x, target) < _worth(tests, x, target):
            break
        tests = best
    return tests


def cover(x: dict[str, np.ndarray], good: np.ndarray, most_rules: int = 24, most_tests: int = 4, precision: float = 0.8, least: int = 5) -> list[Rule]:
    """An ordered list of rules that reject, learned by sequential covering; texts no rule takes are kept.

    A rule must be right for ``precision`` of the rows it covers, in the rows
    it was grown on and in those held back, and cover ``least`` bad ones.
    """
    rules: list[Rule] = []
    n = len(good)
    left = np.ones(n, bool)
    back = np.arange(n) % 3 == 2  # rows come in a hashed order
    while len(rules) < most_rules:
        grow, hold = left & ~back, left & back
        part = {k: v[grow] for k, v in x.items()}
        tests = _grow(part, ~good[grow], most_tests)
        if not tests:
            break
        tests = _prune(tests, {k: v[hold] for k, v in x.items()}, ~good[hold])
        taken = _holds(tests, x, n) & left
        bad, all_ = int((~good[taken]).sum()), int(taken.sum())
        held = taken & back
        if bad < least or bad < precision * all_ or held.any() and (~good[held]).mean() < precision - 0.1:
            break
        rules.append(Rule(tests, False, all_, bad))
        left &= ~taken
    return rules


def learn(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> list[Rule]:
    """Rules from at most ``limit`` labelled rows, chosen by a hash of doc_id.

    Labels without doc_id or quality are left out; of several for one doc_id
    the lowest counts.  Without bad or without good rows the list is empty and
    keeps all.
    """
    chosen = (
        labels.filter("doc_id is not null and quality is not null")
        .groupBy(F.col("doc_id").cast("long").alias("label_id"))
        .agg((F.min("quality") > 0).alias("good"))
        .orderBy(F.xxhash64("label_id"), "label_id")
        .limit(limit)
    )
    side = F.broadcast(chosen) if fits_broadcast(chosen, limit) else chosen
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = own.join(side, F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "good")
    # the gate is looked at here: as a filter it would be worked out for all documents, before the join
    rows = [
        r
        for r in statistics(texts, ("good",))
        .select("doc_id", "good", base_failed().alias("failed"), *[c.alias(k) for k, c in features().items()])
        .orderBy(F.xxhash64("doc_id"), "doc_id", *features())
        .limit(limit)
        .collect()
        if not r["failed"]
    ]
    good = np.array([r["good"] for r in rows], bool)
    return cover({k: np.array([r[k] for r in rows], float) for k in features()}, good)


def as_expression(rules: list[Rule]) -> Column:
    """The list as one ordered conditional: the first rule whose tests hold decides, and no rule keeps."""
    names = features()
    out = None
    for rule in rules:
        condition = F.lit(True)
        for t in rule.tests:
            condition = condition & (names[t.feature] > t.threshold if t.above else names[t.feature] <= t.threshold)
        out = F.when(condition, rule.keep) if out is None else out.when(condition, rule.keep)
    return F.lit(True) if out is None else out.otherwise(True)


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, the base counts, base_failed and kept for every row of ``docs``."""
    verdict = ~F.col("base_failed") & as_expression(rules)
    return statistics(docs).withColumn("base_failed", base_failed()).select("doc_id", *BASE, "base_failed", verdict.alias("kept"))


def keep_good(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of ``docs`` that the learned list keeps, all columns as they were.

    Of the base gate only repetition counts here: a short text is kept unless a rule rejects it.
    """
    rows = docs.select(F.struct("*").alias("_whole"), F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    return statistics(rows, ("_whole",)).filter(~repetitive() & as_expression(rules)).select("_whole.*")
