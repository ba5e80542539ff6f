"""Learned decision lists over text statistics.

Sequential covering: conjunctions of thresholds are grown on two thirds of the labelled
rows by information gain, pruned on the last third, and collected in order until no rule
is precise enough.  The list becomes one Spark conditional expression over the statistics,
so applying it needs no Python.

Defined cases: a null or empty text has zero in every statistic and fails the base rule; a very
long text is counted whole; a null label or id trains nothing; of two labels of one document
the larger counts; without labels the list is empty and keeps whatever passes the base rule;
of conditions that gain equally the first feature's lowest cut is taken; a value at a threshold
is not above it; repeated rows each give a row; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_labelled_sample, stored, text_or_empty, tidy, to_batch

#: Fixed values of the statistics.
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\v\f\r"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

LABELLED_ROWS = 20_000
MIN_PRECISION = 0.9
MIN_COVERED = 4
MAX_RULES = 16
MAX_CONDITIONS = 3
THRESHOLDS = 64

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_marks", "n_distinct", "n_lines")


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words that stand in a window of ``size`` words found twice or more."""
    if len(words) <= size:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    windows = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        windows = windows * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(windows)]
        windows ^= windows >> np.uint64(29)
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + size, -1)
    return int((np.cumsum(edges) > 0).sum())


_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_MARKS = b"!?.,;:"


def count_statistics(text: str) -> tuple[int, ...]:
    raw = text.encode()
    words = raw.split()
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if line.strip(WHITE):
            dup += line in seen
            seen.add(line)
    return (
        len(words),
        len(text) - sum(map(text.count, WHITE)),
        sum(map(text.count, SYMBOLS)),
        dup,
        repeated_words(words),
        len(raw) - len(raw.translate(None, _UPPER)),
        len(raw) - len(raw.translate(None, _DIGITS)),
        len(raw) - len(raw.translate(None, _MARKS)),
        len(set(words)),
        len(lines),
    )


def statistics(documents: DataFrame) -> DataFrame:
    """doc_id and the counts of every whole text."""
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS)])

    def run(batches):
        for batch in batches:
            rows = [count_statistics(t) for t in text_or_empty(batch)]
            yield to_batch(schema, (batch.column(0), *(zip(*rows, strict=True) if rows else [[]] * len(COUNTS))))

    shape = ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS)])
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), shape)


def features() -> dict[str, Column]:
    """The ratios that rules may test; null where their base is zero."""
    words, chars = F.nullif(F.col("n_words"), F.lit(0)), F.nullif(F.col("word_chars"), F.lit(0))
    return {
        "words": F.col("n_words").cast("double"),
        "mean_word": F.col("word_chars") / words,
        "symbol_share": F.col("n_symbols") / chars,
        "dup_line_share": F.col("n_dup_lines") / F.nullif(F.col("n_lines"), F.lit(0)),
        "repeat_share": F.col("n_repeat_words") / words,
        "upper_share": F.col("n_upper") / chars,
        "digit_share": F.col("n_digits") / chars,
        "mark_share": F.col("n_marks") / chars,
        "distinct_share": F.col("n_distinct") / words,
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def mask(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        values = columns[self.feature]
        return values > self.threshold if self.above else values <= self.threshold

    def column(self, features: dict[str, Column]) -> Column:
        value = features[self.feature]
        return F.coalesce(value > self.threshold if self.above else value <= self.threshold, F.lit(False))

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def covered(rule: Rule, columns: dict[str, np.ndarray], n: int) -> np.ndarray:
    mask = np.ones(n, bool)
    for condition in rule:
        mask &= condition.mask(columns)
    return mask


def grow(columns: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Add the condition of the highest gain until only bad rows are covered."""
    rule: list[Condition] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < MAX_CONDITIONS and not bad[inside].all():
        p0, n0 = bad[inside].sum(), inside.sum()
        best, best_gain = None, 1e-9
        for name, values in columns.items():
            shown = values[inside]
            shown, wrong = shown[~np.isnan(shown)], bad[inside][~np.isnan(shown)]
            if not len(shown):
                continue
            order = np.argsort(shown, kind="stable")
            ordered, sums = shown[order], np.cumsum(wrong[order])
            cuts = np.flatnonzero(ordered[1:] > ordered[:-1])
            if len(cuts) > 4 * THRESHOLDS:  # quantiles of all rows and of the bad ones
                marks = np.searchsorted(sums, np.linspace(1, sums[-1], THRESHOLDS))
                even = np.linspace(0, len(cuts) - 1, THRESHOLDS).astype(int)
                near = np.clip(np.searchsorted(cuts, np.concatenate((marks, marks - 1))), 0, len(cuts) - 1)
                cuts = cuts[np.unique(np.concatenate((even, near)))]
            for above in (False, True):
                n1 = cuts + 1 if not above else len(ordered) - cuts - 1
                p1 = sums[cuts] if not above else sums[-1] - sums[cuts]
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p1 > 0, p1 * (np.log2(p1 / n1) - np.log2(p0 / n0)), -1)
                if len(gain) and gain.max() > best_gain:
                    k = int(gain.argmax())
                    best_gain = float(gain[k])
                    best = Condition(name, above, float((ordered[cuts[k]] + ordered[cuts[k] + 1]) / 2))
        if best is None:
            break
        rule.append(best)
        inside &= best.mask(columns)
    return tuple(rule)


def prune(rule: Rule, columns: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The leading conditions with the best (p - n) / (p + n) on rows that did not grow them."""

    def worth(part: Rule) -> float:
        inside = covered(part, columns, len(bad))
        p, n = bad[inside].sum(), inside.sum()
        return (2 * p - n) / n if n else -1.0

    parts = [rule[:k] for k in range(1, len(rule) + 1)]
    return max(parts, key=lambda part: (worth(part), -len(part))) if parts else ()


def learn(columns: dict[str, np.ndarray], bad: np.ndarray) -> list[Rule]:
    """The ordered rules that reject; ``bad`` marks rows of label 0."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    growing = np.arange(len(bad)) % 3 != 2
    while len(rules) < MAX_RULES and bad[left & growing].any():
        grow_on, prune_on = left & growing, left & ~growing
        rule = grow({k: v[grow_on] for k, v in columns.items()}, bad[grow_on])
        rule = prune(rule, {k: v[prune_on] for k, v in columns.items()}, bad[prune_on])
        inside = covered(rule, columns, len(bad)) & left
        if not rule or inside.sum() < MIN_COVERED or bad[inside].mean() < MIN_PRECISION:
            break
        rules.append(rule)
        left &= ~inside
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one conditional: the first rule that holds rejects, else the row is kept."""
    shown, chain = features(), None
    for rule in rules:
        holds = F.lit(True)
        for condition in rule:
            holds = holds & condition.column(shown)
        chain = F.when(holds, False) if chain is None else chain.when(holds, False)
    return F.lit(True) if chain is None else chain.otherwise(True)


def fit(documents: DataFrame, labels: DataFrame, limit: int = LABELLED_ROWS) -> list[Rule]:
    """Learn from at most ``limit`` labelled documents that pass the base rule."""
    sample = stored(bounded_labelled_sample(documents, labels, "quality", limit), "labelled-sample")
    shown = features()
    # the same statistics as at application, of the sample's texts alone
    rated = statistics(sample).join(F.broadcast(sample.select("doc_id", "y")), "doc_id").where(~base_failed())
    rows = rated.select("doc_id", "y", *(c.alias(n) for n, c in shown.items())).toArrow().sort_by([("doc_id", "ascending")])
    columns = {n: rows.column(n).to_numpy().astype(float) for n in shown}
    return learn(columns, rows.column("y").to_numpy() == 0)


def apply(documents: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, counts, base_failed and kept of every document."""
    failed = F.col("base_failed")
    return statistics(documents).withColumn("base_failed", base_failed()).withColumn("kept", F.when(failed, False).otherwise(verdict(rules)))


def rated(documents: DataFrame, labels: DataFrame) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return apply(documents, fit(documents, labels)).select(columns)
