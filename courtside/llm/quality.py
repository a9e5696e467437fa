"""Quality rules: a decision list learned from labelled documents.

Sequential covering grows one conjunction of threshold tests at a time on two thirds of the
labelled sample, prunes it on the last third, and keeps it while it is precise there. The
list comes out as one ordered Spark CASE expression over the statistics of a text.

Defined cases: a null or empty text has no words (all counts 0) and fails the base rule; a
label that is null or neither 0 nor 1 is not learned from; without both labels the list is
empty and only the base rule decides; repeated rows are judged alike; equal gains take the
first feature in the order of ``RATIOS`` and then the smaller threshold. Other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from courtside.llm.shared import fresh, source, SPACED_WORD

# Labelled rows the list is learned from, at most; they come to the driver as numbers only.
SAMPLE_ROWS = 20_000
WINDOW = 8
# A pruned rule must be this precise on rows it was not grown on.
LEAST_PRECISION = 0.97
MOST_TESTS = 4
MOST_RULES = 24
THRESHOLDS = 48

SYMBOLS = "#*$%&|<>"
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_upper_words", "n_distinct_words", "n_exclaims", "n_pipes", "n_stops", "n_lines",
)
_STRUCT = pa.struct([(name, pa.int64()) for name in COUNTS])
_TYPE = T.StructType([T.StructField(name, T.LongType()) for name in COUNTS])
_MULTIPLIERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(WINDOW)], dtype=np.uint64)


def repeated_window_words(words: list[str]) -> int:
    """Words inside 8-word windows that occur twice or more, the first occurrence included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    mixed = np.zeros(n, dtype=np.uint64)
    for k in range(WINDOW):
        mixed += codes[k : k + n] * _MULTIPLIERS[k]
    order = np.argsort(mixed, kind="stable")
    ranked = mixed[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    # Equal sums are only candidates; the windows themselves decide.
    starts: dict[tuple, list[int]] = {}
    for at in np.sort(order[twice]).tolist():
        starts.setdefault(tuple(words[at : at + WINDOW]), []).append(at)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for found in starts.values():
        if len(found) > 1:
            edge[found] += 1
            edge[np.array(found) + WINDOW] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum())


def statistics(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = SPACED_WORD.findall(text)
    lines = text.split("\n")
    worded = [line for line in lines if line.strip(" \t\n\v\f\r")]
    return (
        len(words),
        len("".join(words)),
        sum(text.count(symbol) for symbol in SYMBOLS),
        len(worded) - len(set(worded)),
        repeated_window_words(words),
        sum(map(str.isupper, words)),
        len(set(words)),
        text.count("!"),
        text.count("|"),
        text.count("."),
        len(worded),
    )


@F.arrow_udf(_TYPE)
def _statistics(texts: pa.Array) -> pa.Array:
    columns = list(zip(*[statistics(text.as_py()) for text in texts])) or [[] for _ in COUNTS]
    return pa.StructArray.from_arrays(
        [pa.array(column, type=pa.int64()) for column in columns], fields=list(_STRUCT)
    )


# Marked so that a filter on the outcome does not make Spark run it a second time.
_statistics = _statistics.asNondeterministic()


def with_statistics(rows: DataFrame, text: str = "text", into: str = "stats") -> DataFrame:
    return rows.withColumn(into, _statistics(F.col(text)))


def _per(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def ratios(stats: str = "stats") -> dict[str, Column]:
    """The learner's features; each is a plain expression over the counts."""
    c = {name: F.col(f"{stats}.{name}") for name in COUNTS}
    return {
        "words": c["n_words"].cast("double"),
        "word_length": _per(c["word_chars"], c["n_words"]),
        "symbols_per_word": _per(c["n_symbols"], c["n_words"]),
        "repeated_lines": _per(c["n_dup_lines"], c["n_lines"]),
        "repeated_words": _per(c["n_repeat_words"], c["n_words"]),
        "upper_words": _per(c["n_upper_words"], c["n_words"]),
        "distinct_words": _per(c["n_distinct_words"], c["n_words"]),
        "exclaims_per_word": _per(c["n_exclaims"], c["n_words"]),
        "pipes_per_word": _per(c["n_pipes"], c["n_words"]),
        "stops_per_word": _per(c["n_stops"], c["n_words"]),
        "lines_per_word": _per(c["n_lines"], c["n_words"]),
    }


RATIOS = (
    "words", "word_length", "symbols_per_word", "repeated_lines", "repeated_words", "upper_words",
    "distinct_words", "exclaims_per_word", "pipes_per_word", "stops_per_word", "lines_per_word",
)


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def column(self, features: dict[str, Column]) -> Column:
        value = features[self.feature]
        return value >= F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def mask(self, values: np.ndarray) -> np.ndarray:
        column = values[:, RATIOS.index(self.feature)]
        return column >= self.threshold if self.above else column <= self.threshold


def _covered(tests: list[Test], values: np.ndarray) -> np.ndarray:
    mask = np.ones(len(values), dtype=bool)
    for test in tests:
        mask &= test.mask(values)
    return mask


def _best_test(values: np.ndarray, bad: np.ndarray) -> tuple[float, Test] | None:
    """The test with the largest information gain over the rows it keeps."""
    p0, n0 = int(bad.sum()), int((~bad).sum())
    before = np.log2(p0 / (p0 + n0))
    best = None
    for column, feature in enumerate(RATIOS):
        value = values[:, column]
        cuts = np.unique(np.quantile(value[bad], np.linspace(0, 1, THRESHOLDS), method="nearest"))
        for above in (True, False):
            for cut in cuts.tolist():
                mask = value >= cut if above else value <= cut
                p = int((mask & bad).sum())
                n = int((mask & ~bad).sum())
                if p == 0:
                    continue
                gain = p * (np.log2(p / (p + n)) - before)
                if best is None or gain > best[0] + 1e-9:
                    best = (gain, Test(feature, above, float(cut)))
    return best


def _grow(values: np.ndarray, bad: np.ndarray) -> list[Test]:
    tests: list[Test] = []
    while len(tests) < MOST_TESTS and (~bad).any():
        best = _best_test(values, bad)
        if best is None or best[0] <= 1e-9:
            break
        tests.append(best[1])
        kept = best[1].mask(values)
        values, bad = values[kept], bad[kept]
    return tests


def _prune(tests: list[Test], values: np.ndarray, bad: np.ndarray) -> list[Test]:
    """The shortest prefix with the best (right - wrong) / covered on rows kept aside."""

    def worth(k: int) -> float:
        mask = _covered(tests[:k], values)
        p, n = int((mask & bad).sum()), int((mask & ~bad).sum())
        return (p - n) / (p + n) if p + n else -1.0

    return tests[: max(range(1, len(tests) + 1), key=lambda k: (worth(k), -k))] if tests else tests


def learn(values: np.ndarray, bad: np.ndarray, aside: np.ndarray) -> list[list[Test]]:
    """Ordered rules that reject; ``aside`` marks the rows kept for pruning."""
    rules: list[list[Test]] = []
    while len(rules) < MOST_RULES:
        if (bad & ~aside).sum() < 5 or not (~bad & ~aside).any():
            break
        tests = _prune(_grow(values[~aside], bad[~aside]), values[aside], bad[aside])
        if not tests:
            break
        held = _covered(tests, values)
        p, n = int((held & bad & aside).sum()), int((held & ~bad & aside).sum())
        grown = int((held & bad & ~aside).sum()), int((held & ~bad & ~aside).sum())
        if p < 2 or p / (p + n) < LEAST_PRECISION or grown[0] / max(sum(grown), 1) < LEAST_PRECISION:
            break
        rules.append(tests)
        values, bad, aside = values[~held], bad[~held], aside[~held]
    return rules


def learn_rules(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[list[Test]]:
    """Learn from at most ``sample_rows`` labelled documents, drawn by a hash of their ids."""
    drawn = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", "quality").distinct()
    drawn = drawn.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample_rows)
    # At most sample_rows pairs of numbers, so the broadcast is bounded.
    labelled = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    found = with_statistics(labelled).select(
        "doc_id", "quality", *[value.alias(name) for name, value in ratios().items()]
    )
    # Repeated ids could give more rows than were drawn.
    rows = found.orderBy(F.xxhash64("doc_id"), *found.columns).limit(sample_rows).toArrow()
    values = np.column_stack([rows[name].to_numpy() for name in RATIOS]) if rows.num_rows else np.empty((0, len(RATIOS)))
    bad = rows["quality"].to_numpy() == 0 if rows.num_rows else np.empty(0, dtype=bool)
    aside = np.arange(len(bad)) % 3 == 2
    return learn(values, bad, aside)


def decision(rules: list[list[Test]], stats: str = "stats") -> Column:
    """Number of the first rule that holds, else null."""
    features = ratios(stats)
    outcome = F.lit(None).cast("int")
    for number in range(len(rules) - 1, -1, -1):
        holds = F.lit(True)
        for test in rules[number]:
            holds = holds & test.column(features)
        outcome = F.when(holds, F.lit(number)).otherwise(outcome)
    return outcome


def base_failed(stats: str = "stats") -> Column:
    words, repeated = F.col(f"{stats}.n_words"), F.col(f"{stats}.n_repeat_words")
    return (words < 20) | (100 * repeated > 30 * words)


def judge(docs: DataFrame, rules: list[list[Test]], into: str = "_judged") -> DataFrame:
    """``docs`` with one struct column more: the counts, base_failed, the rule that rejects
    (its number, or null) and kept. ``into`` is the only name added."""
    judged = with_statistics(docs, into=into)
    rule, failed = decision(rules, into), base_failed(into)
    return judged.withColumn(
        into,
        F.struct(
            *[F.col(f"{into}.{c}").alias(c) for c in COUNTS],
            failed.alias("base_failed"),
            rule.alias("rule"),
            (~failed & rule.isNull()).alias("kept"),
        ),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = source(spark, sf_dir, "documents")
    rules = learn_rules(docs, source(spark, sf_dir, "labels"))
    judged = judge(docs.select("doc_id", "text"), rules)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *[f"_judged.{c}" for c in (*counts, "base_failed", "kept", "rule")])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass; the rules are learned on this stage's own input."""
    rules = learn_rules(docs, source(spark, sf_dir, "labels"))
    (into,) = fresh(docs, "_judged")
    return judge(docs, rules, into).where(F.col(f"{into}.kept")).drop(into)
