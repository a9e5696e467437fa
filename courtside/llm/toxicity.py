"""Toxicity by a learned weighted lexicon, matched with Aho-Corasick on folded text.

Folding lower-cases, undoes compatibility forms, look-alike letters and digits that stand for
letters, and leaves words with single spaces between them. Lexicon entries are whole words or word
beginnings, with their log-odds as weights. Words inside an exception phrase do not count. The sum of
weights, plain and per hundred words, is calibrated into a probability on the training rows.

Defined cases: null and empty texts have no words and get the score of a text without hits;
labels other than 0 and 1 are not learned from; without both labels the lexicon is empty
and every score is 0; repeated rows are scored alike; equal gains take the entry that sorts first; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from courtside.llm.shared import chunks, source
from courtside.workspace import staged

# Labelled rows the lexicon is learned from, at most, by label; drawn by a hash of the id.
TOXIC_ROWS, CLEAN_ROWS = 4_000, 16_000
CANDIDATES, ENTRIES = 20_000, 2_000
LEAST_DOCS = 4
LEAST_WEIGHT = 2.5
# Of the training rows that hold an entry at least this share is toxic.
LEAST_PRECISION = 0.97
# Entries are added until each toxic row holds this many, as far as it can.
COVER = 3
PREFIXES = (4, 5, 6)

# Letters of other scripts that look like Latin ones, and digits read as letters.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l",
    "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "х": "x", "ᴢ": "z",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ո": "n", "օ": "o", "ս": "u",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
EXCEPTIONS = ("trash can", "trash bin", "class clown", "clown fish")

_LOOKALIKE = re.compile("[" + "".join(LOOKALIKES) + "]")
_LOOKALIKE_MAP = str.maketrans(LOOKALIKES)
_STANDING = re.compile(r"[0134578@$]+(?=[^\W\d_])")
_DIGIT_MAP = str.maketrans(DIGITS)
_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_WORD = re.compile(r"[^\W_]+")


def folded_words(text: str | None) -> list[str]:
    if not text:
        return []
    text = text.casefold()
    if not text.isascii():
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text).casefold()
        text = _INVISIBLE.sub("", text)
        if _LOOKALIKE.search(text):
            text = text.translate(_LOOKALIKE_MAP)
    text = _STANDING.sub(lambda m: m.group().translate(_DIGIT_MAP), text)
    return _WORD.findall(text)


def features_of(words: list[str]) -> set[str]:
    """`` word `` for whole words and `` begin`` for word beginnings."""
    distinct = set(words)
    found = {f" {w} " for w in distinct}
    for size in PREFIXES:
        found |= {f" {w[:size]}" for w in distinct if len(w) > size}
    return found


@dataclass
class Lexicon:
    entries: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    # Intercept and slopes over (log of the sum, log of the sum per hundred words).
    model: tuple[float, float, float] | None = None


class Matcher:
    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.lexicon = lexicon
        self.machine = ahocorasick.Automaton()
        for entry, weight in lexicon.entries.items():
            self.machine.add_word(entry, (len(entry), weight))
        for phrase in lexicon.exceptions:
            self.machine.add_word(f" {phrase} ", (len(phrase) + 2, None))
        if len(self.machine):
            self.machine.make_automaton()

    def hits(self, words: list[str]) -> list[tuple[int, float]]:
        """(start of the word, weight), one per word: its heaviest entry, if no exception covers it."""
        if not words or not len(self.machine):
            return []
        best: dict[int, float] = {}
        free: list[tuple[int, int]] = []
        for end, (size, weight) in self.machine.iter(f" {' '.join(words)} "):
            start = end - size + 1
            if weight is None:
                free.append((start, end))
            elif weight > best.get(start, 0.0):
                best[start] = weight
        if not free:
            return list(best.items())
        # Exceptions come by their ends; the furthest end of those that begin at or before a word decides.
        free.sort()
        out, at, reach = [], 0, -1
        for start in sorted(best):
            while at < len(free) and free[at][0] <= start:
                reach = max(reach, free[at][1])
                at += 1
            if start >= reach:
                out.append((start, best[start]))
        return out

    def evidence(self, words: list[str]) -> tuple[float, float]:
        total = sum(weight for _, weight in self.hits(words))
        return math.log1p(total), math.log1p(100.0 * total / len(words)) if words else 0.0

    def score(self, text: str | None) -> float:
        if self.lexicon.model is None:
            return 0.0
        bias, plain, dense = self.lexicon.model
        a, b = self.evidence(folded_words(text))
        return 1.0 / (1.0 + math.exp(-max(min(bias + plain * a + dense * b, 500.0), -500.0)))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic): at most TOXIC_ROWS and CLEAN_ROWS of the labelled rows that are not held out."""
    usable = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id")))
    usable = usable.select("doc_id", "toxic").distinct()

    def drawn(label: int, most: int) -> DataFrame:
        return usable.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    # At most TOXIC_ROWS + CLEAN_ROWS pairs of numbers, so the broadcast is bounded.
    chosen = drawn(1, TOXIC_ROWS).unionByName(drawn(0, CLEAN_ROWS))
    # Of rows of one id, or of two labels for it, the one of least hash and label is taken, whatever their order.
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    first = F.min(F.struct(F.xxhash64("text").alias("hash"), "toxic", "text")).alias("row")
    return met.groupBy("doc_id").agg(first).select("doc_id", "row.text", "row.toxic")


def _counts(rows: DataFrame, only: list[str] | None) -> DataFrame:
    """(feature, n): rows holding each feature, or each feature of ``only``."""
    wanted = None if only is None else frozenset(only)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", 8 << 20):
                found: Counter[str] = Counter()
                for text in part.column("text").to_pylist():
                    features = features_of(folded_words(text))
                    found.update(features if wanted is None else features & wanted)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["feature", "n"]
                )

    return rows.select("text").mapInArrow(count, "feature string, n bigint").groupBy("feature").agg(F.sum("n").alias("n"))


def _weights(train: DataFrame) -> dict[str, float]:
    """Candidate entries: features of toxic rows, with their log-odds, at most CANDIDATES."""
    toxic, clean = train.where("toxic = 1"), train.where("toxic = 0")
    sizes = train.groupBy().agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    if not sizes or not sizes[0] or not sizes[1]:
        return {}
    common = _counts(toxic, None).where(F.col("n") >= LEAST_DOCS).orderBy(F.desc("n"), "feature").limit(CANDIDATES)
    in_toxic = dict(map(tuple, common.collect()))
    in_clean = dict(map(tuple, _counts(clean, list(in_toxic)).collect()))
    found = {}
    for feature, n in in_toxic.items():
        clean_rows = in_clean.get(feature, 0)
        odds = math.log((n + 0.5) / (sizes[0] + 1)) - math.log((clean_rows + 0.5) / (sizes[1] + 1))
        if odds >= LEAST_WEIGHT and n >= LEAST_PRECISION * (n + clean_rows):
            found[feature] = odds
    return found


def _cover(holding: list[list[str]], weights: dict[str, float]) -> list[str]:
    """Whole words first, then beginnings for the rows that no chosen word is in, longer ones first among equals.

    A beginning also stands in words of no harm, so it has to earn its place by rows of its own.
    """
    whole = [[f for f in held if f.endswith(" ")] for held in holding]
    chosen = _greedy(whole, weights, COVER, ENTRIES)
    words = set(chosen)
    rest = [[] if words.intersection(held) else [f for f in held if not f.endswith(" ")] for held in holding]
    return chosen + _greedy(rest, weights, 1, ENTRIES - len(chosen))


def _greedy(holding: list[list[str]], weights: dict[str, float], cover: int, most: int) -> list[str]:
    """Greedy choice of entries until every row holds ``cover`` of them, heaviest gain first.

    Words that merely came along in copies of one toxic text add little once its own are chosen.
    """
    rows_of: dict[str, set[int]] = {}
    for row, held in enumerate(holding):
        for feature in held:
            rows_of.setdefault(feature, set()).add(row)
    missing = [cover] * len(holding)
    chosen: list[str] = []
    while rows_of and len(chosen) < most:
        best = max(sorted(rows_of), key=lambda f: (len(rows_of[f]), len(f) if cover == 1 else 0, weights[f]))
        rows = rows_of.pop(best)
        if len(rows) < LEAST_DOCS:
            break
        chosen.append(best)
        for row in rows:
            missing[row] -= 1
            if missing[row] == 0:
                for feature in holding[row]:
                    if feature in rows_of:
                        rows_of[feature].discard(row)
    return chosen


def _calibrate(evidence: np.ndarray, toxic: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton steps, lightly penalised; slopes stay at zero or above."""
    x = np.column_stack([np.ones(len(evidence)), evidence])
    w = np.zeros(3)
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        penalty = np.array([1e-6, 1e-2, 1e-2])
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(penalty + 1e-9), x.T @ (toxic - p) - penalty * w)
        w = w + np.clip(step, -5, 5)
        w[1:] = np.maximum(w[1:], 0.0)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1]), float(w[2])


def learn_lexicon(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """Learned on a bounded sample of labelled rows; what reaches the driver is bounded by the constants above."""
    train = staged(training_rows(docs, labels), "toxicity-train")
    weights = _weights(train)
    if not weights:
        return Lexicon()
    known = frozenset(weights)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [sorted(features_of(folded_words(text)) & known) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string()))], names=["held"])

    toxic_rows = train.where("toxic = 1").select("text").mapInArrow(held, "held array<string>").orderBy("held").collect()
    chosen = _cover([row[0] for row in toxic_rows], weights)
    lexicon = Lexicon({entry: weights[entry] for entry in chosen}, EXCEPTIONS)
    lexicon = Lexicon(lexicon.entries, tuple(sorted({*EXCEPTIONS, *_learned_exceptions(train, lexicon)})))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in batches:
            pairs = [matcher.evidence(folded_words(text)) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([p[0] for p in pairs], pa.float64()), pa.array([p[1] for p in pairs], pa.float64()),
                 batch.column("toxic")],
                names=["doc_id", "a", "b", "toxic"],
            )

    kept = train.select(F.col("doc_id").cast("bigint"), "text", F.col("toxic").cast("int"))
    found = kept.mapInArrow(weigh, "doc_id bigint, a double, b double, toxic int").orderBy("doc_id").toArrow()
    evidence = np.column_stack([found["a"].to_numpy(), found["b"].to_numpy()])
    return Lexicon(lexicon.entries, lexicon.exceptions, _calibrate(evidence, found["toxic"].to_numpy().astype(float)))


def _learned_exceptions(train: DataFrame, lexicon: Lexicon) -> list[str]:
    """Two-word phrases around an entry that several clean training rows hold and no toxic one does."""

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in batches:
            out: list[tuple[str, int]] = []
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                words = folded_words(text)
                starts = {start for start, _ in matcher.hits(words)}
                at, found = 0, set()
                for i, word in enumerate(words):
                    if at in starts:
                        found |= {" ".join(words[j : j + 2]) for j in (i - 1, i) if 0 <= j and j + 1 < len(words)}
                    at += len(word) + 1
                out += [(phrase, toxic) for phrase in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int32())], names=["phrase", "toxic"]
            )

    seen = train.select("text", F.col("toxic").cast("int")).mapInArrow(phrases, "phrase string, toxic int")
    counted = seen.groupBy("phrase").agg(F.count_if(F.col("toxic") == 1).alias("bad"), F.count_if(F.col("toxic") == 0).alias("good"))
    rows = counted.where("bad = 0 and good >= 3").orderBy(F.desc("good"), "phrase").limit(ENTRIES).collect()
    return [row[0] for row in rows]


def score_column(lexicon: Lexicon, text: Column | str) -> Column:
    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = Matcher(lexicon)
        for texts in batches:
            yield pa.array([matcher.score(text.as_py()) for text in texts], pa.float64())

    return score.asNondeterministic()(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = source(spark, sf_dir, "documents")
    lexicon = learn_lexicon(docs, source(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(lexicon, "text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
