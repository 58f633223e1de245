"""Quality rules: a decision list learned from labelled statistics, as Spark conditions.

DataFrame functions only; the driver sees a contingency table of bounded size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm.common import crc_remainder, durable, table, words_of

REPEAT_WINDOW = 8
#: Shares the rules may test, and the quantiles of each label's texts that are tried as thresholds.
SHARES = ("symbol_share", "dup_line_share", "repeat_share", "exclaim_share", "upper_share", "run_share")
QUANTILES = {0: (0.1, 0.3, 0.5, 0.7, 0.9), 1: (0.005, 0.995)}


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts and shares of each whole text.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (bigint) and the
    SHARES (double, 0 for texts without words). Null and empty texts count as
    texts without words. Columns of docs with these names are replaced. One pass,
    no shuffle; windows are told apart by a 64-bit hash of hashes of their words.
    """
    size = lambda c: F.size(c).cast("bigint")
    shifted = lambda c, by: F.zip_with(F.slice(c, F.lit(1), F.size(c) - by), F.slice(c, F.lit(1 + by), F.size(c) - by), lambda x, y: F.xxhash64(x, y))
    none = F.array().cast("array<bigint>")
    step = docs.withColumn("__text", F.coalesce(F.col(text), F.lit(""))).withColumn("__w", words_of(F.col("__text")))
    step = step.withColumn("__h", F.transform("__w", lambda w: F.xxhash64(w)))
    next_is_equal = F.zip_with(F.slice("__h", F.lit(1), F.size("__h") - 1), F.slice("__h", F.lit(2), F.size("__h") - 1), lambda x, y: x == y)
    step = step.withColumn("__runs", F.when(F.size("__h") > 1, F.size(F.filter(next_is_equal, lambda x: x))).otherwise(0))
    for by in (1, 2, 4):  # hashes of 2, 4, 8 words
        step = step.withColumn("__h", F.when(F.size("__h") > by, shifted(F.col("__h"), by)).otherwise(none))
    twice = F.size(F.array_distinct("__h")) < F.size("__h")
    step = step.withColumn("__s", F.when(twice, F.array_sort(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    met = lambda p, i: (F.get("__s", i - 1)["h"] == p["h"]) | (F.get("__s", i + 1)["h"] == p["h"])
    step = step.withColumn("__p", F.array_sort(F.transform(F.filter("__s", lambda p, i: F.coalesce(met(p, i), F.lit(False))), lambda p: p["i"])))
    covered = F.transform("__p", lambda p, i: F.least(F.lit(REPEAT_WINDOW), F.coalesce(F.get("__p", i + 1) - p, F.lit(REPEAT_WINDOW))))
    step = step.withColumn("__lines", F.filter(F.split("__text", "\n"), lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]"))))
    counted = step.withColumns(
        {
            "n_words": size("__w"),
            "word_chars": F.length(F.array_join("__w", "")).cast("bigint"),
            "n_symbols": F.regexp_count("__text", F.lit("[#*$%&|<>]")).cast("bigint"),
            "n_dup_lines": size("__lines") - size(F.array_distinct("__lines")),
            "n_repeat_words": F.coalesce(F.aggregate(covered, F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(0).cast("bigint")),
            "__exclaims": F.regexp_count("__text", F.lit("!")),
            "__upper": F.regexp_count("__text", F.lit("[A-Z]")),
            "__n_lines": F.size("__lines"),
        }
    )
    share = lambda part, whole: F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole)), F.lit(0.0))
    shared = counted.withColumns(
        {
            "symbol_share": share("n_symbols", "word_chars"),
            "dup_line_share": share("n_dup_lines", "__n_lines"),
            "repeat_share": share("n_repeat_words", "n_words"),
            "exclaim_share": share("__exclaims", "word_chars"),
            "upper_share": share("__upper", "word_chars"),
            "run_share": share("__runs", "n_words"),
        }
    )
    return shared.drop(*(c for c in shared.columns if c.startswith("__")))


#: A statistic, whether it reaches or misses a threshold, and which.
Test = tuple[str, bool, int]


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, whether at least or below, threshold)."""

    tests: tuple[tuple[str, bool, float], ...]
    precision: float
    covered: int

    def condition(self) -> Column:
        return reduce(lambda a, b: a & b, [F.col(name) >= t if up else F.col(name) < t for name, up, t in self.tests])

    def __str__(self) -> str:
        return " and ".join(f"{name} {'>=' if up else '<'} {t:.6g}" for name, up, t in self.tests) + f"  [{self.precision:.3f} of {self.covered}]"


@dataclass
class DecisionList:
    rules: list[Rule] = field(default_factory=list)

    def verdict(self) -> Column:
        """True unless one of the rules, asked in order, rejects the text."""
        out = F.lit(True)
        for rule in reversed(self.rules):
            out = F.when(rule.condition(), F.lit(False)).otherwise(out)
        return out


class _Cells:
    """Counts of rows by label, by part, and by how many thresholds of each statistic they reach."""

    def __init__(self, rows: list):
        self.rows = rows

    def where(self, *tests: Test) -> _Cells:
        return _Cells([c for c in self.rows if all((c[name] > i) == up for name, up, i in tests)])

    def without(self, tests: list[Test]) -> _Cells:
        return _Cells([c for c in self.rows if not all((c[name] > i) == up for name, up, i in tests)])

    def part(self, prune: bool) -> _Cells:
        return _Cells([c for c in self.rows if c["prune"] == prune])

    def counts(self) -> tuple[int, int]:
        """Rows to reject, and rows to keep."""
        bad = sum(c["count"] for c in self.rows if c["label"] == 0)
        return bad, sum(c["count"] for c in self.rows) - bad


def _gain(before: tuple[int, int], after: tuple[int, int]) -> float:
    """FOIL's gain: rows to reject that stay covered, times the bits by which they became purer."""
    (p0, n0), (p, n) = before, after
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def _worth(counts: tuple[int, int]) -> float:
    p, n = counts
    return (p - n) / (p + n) if p + n else -1.0


def grow(cells: _Cells, tests: list[Test], start: Test, most: int) -> list[Test]:
    """start and further tests, each the one of greatest gain, until no row to keep is covered or none gains."""
    chosen, now = [start], cells.where(start)
    while len(chosen) < most and now.counts()[1]:
        gain, best = max(((_gain(now.counts(), now.where(t).counts()), t) for t in tests), key=lambda x: x[0])
        if gain <= 1e-9:
            break
        chosen.append(best)
        now = now.where(best)
    return chosen


def prune(cells: _Cells, chosen: list[Test]) -> list[Test]:
    """The rule without the tests whose loss does not make it worth less on these rows."""
    worth = lambda some: _worth(cells.where(*some).counts())
    while len(chosen) > 1:
        shorter = max(([t for t in chosen if t != drop] for drop in chosen), key=worth)
        if worth(shorter) < worth(chosen):
            break
        chosen = shorter
    return chosen


def learn(labelled: DataFrame, label: str = "quality", key: str = "doc_id", min_precision: float = 0.95, min_covered: int = 5, max_rules: int = 8, max_tests: int = 3) -> DecisionList:
    """Sequential covering of the rows with label 0.

    labelled: the SHARES, the key and the label (0 or 1; other and null labels
    are left out). All rows count: they are grouped by which thresholds they
    reach, which gives at most two classes, two folds and 8**6 cells however
    many rows there are, and that table alone comes to the driver. A rule grows
    on two thirds of the rows by FOIL's gain, from the first test of greatest
    gain on, and is pruned on the last third; it stays if it is right for
    ``min_precision`` of the rows that it covers in each part, at least
    ``min_covered`` in all. If it does not, the next best first test is tried;
    when none is left, the list ends. No labels, or none of a class, give an
    empty list, which keeps everything.
    """
    usable = labelled.where(F.col(label).isin(0, 1))
    at = lambda s, side: F.percentile_approx(F.when(F.col(label) == side, F.col(s)), F.array(*map(F.lit, QUANTILES[side])), 10000)
    found = usable.select(*(at(s, side).alias(f"{s}{side}") for s in SHARES for side in QUANTILES)).first()
    grid = {s: sorted({t for side in QUANTILES for t in found[f"{s}{side}"] or []}) for s in SHARES}
    reached = [sum((F.col(s) >= t).cast("int") for t in grid[s]) if grid[s] else F.lit(0) for s in SHARES]
    left = _Cells(
        usable.select(F.col(label).cast("int").alias("label"), (crc_remainder(F.col(key), 3) == 0).alias("prune"), *(r.alias(s) for r, s in zip(reached, SHARES, strict=True)))
        .groupBy("label", "prune", *SHARES)
        .count()
        .collect()
    )
    tests = [(s, up, i) for s in SHARES for i in range(len(grid[s])) for up in (True, False)]

    def next_rule() -> list[Test] | None:
        parts = left.part(False), left.part(True)
        gains = {t: _gain(parts[0].counts(), parts[0].where(t).counts()) for t in tests}
        for start in sorted((t for t in tests if gains[t] > 1e-9), key=lambda t: -gains[t]):
            chosen = prune(parts[1], grow(parts[0], tests, start, max_tests))
            covered = [part.where(*chosen).counts() for part in parts]
            right = all(p >= min_precision * (p + n) for p, n in covered)
            if right and covered[0][0] and sum(map(sum, covered)) >= min_covered:
                return chosen
        return None

    rules: list[Rule] = []
    while len(rules) < max_rules and (chosen := next_rule()) is not None:
        bad, good = left.where(*chosen).counts()
        rules.append(Rule(tuple((s, up, float(grid[s][i])) for s, up, i in chosen), bad / (bad + good), bad + good))
        left = left.without(chosen)
    return DecisionList(rules)


def judge_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """The key with the statistics, base_failed and kept, one row for each row of docs.

    base_failed: fewer than 20 words, or over 30 % of the words in repeated
    windows. kept: false if base_failed, else the learned list's verdict; the
    list is learned from the labelled texts that pass the base. Texts that no
    rule covers are kept. Null keys have no labels, but are judged.
    """
    statistics = durable(text_statistics(docs.select(key, text), text).drop(text).withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))))
    known = labels.select(F.col(key).alias("__key"), F.col(label).alias("__label"))
    labelled = statistics.where("not base_failed").join(known, F.col(key) == F.col("__key")).withColumnRenamed("__label", label)
    return statistics.withColumn("kept", ~F.col("base_failed") & learn(labelled, label, key).verdict())


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
