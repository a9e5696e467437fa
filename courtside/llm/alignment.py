"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes of a text.

Both encodings of a text are lists of increasing byte offsets at which tokens end. The shorter list
drives an exponential-plus-binary search into the longer: each end starts where an earlier one was
found, doubles its step until it has passed, and halves the last step. That gives every end its rank
in the longer list. Ends found in both lists cut the text into groups of tokens that cover the same
bytes, and the difference of two neighbouring ranks is the range of tokens one token overlaps; no pair of
tokens is ever tried. The searches of many texts run side by side in arrays.

``aligned`` gives the groups and links of each document, ``pair_counts`` the number of documents that
hold each linked pair of ids, ``scored`` both together. Counts meet the documents' links again in two
ways, whatever the size: pairs that stand in many documents are few (at most ``HOT_PAIRS``, since the counts
of all pairs have a known sum) and are broadcast, the others are joined by a shuffle in which no key
has more rows than the bound between the two.

Defined cases: texts that are null or empty, or that one of the vocabularies does not give back byte for
byte, have no tokens and keep their row. Rows are counted one by one, so a repeated document, with an id or
without, counts as often as it stands there. Ties for the highest count all count as highest. Empty
tables give empty tables. Only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from courtside.llm.shared import chunks, source
from courtside.workspace import scratch_path

BYTE_MODEL = public_tokenizers.path("byte_bpe_50k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
MARK = "▁"
# Bytes of text encoded and aligned together.
TOGETHER = 1 << 19
# At most so many pairs of ids are broadcast.
HOT_PAIRS = 1 << 19
# Ends that start their search from one leader's place.
FOLLOWERS = 16

ALIGNED = (
    "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
    "pairs array<bigint>, times array<int>"
)


def byte_letters() -> dict[str, int]:
    """The byte each letter of a byte-level vocabulary stands for: printable bytes stand for
    themselves, the others in order for the letters from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (value for value in range(256) if value not in printable)
    return {chr(value): value for value in printable} | {chr(0x100 + i): value for i, value in enumerate(others)}


@dataclass
class ByteVocabulary:
    """A byte-level BPE vocabulary; ``texts`` are the bytes of each id."""

    texts: list[bytes]

    def __post_init__(self) -> None:
        self.sizes = np.array([len(text) for text in self.texts], np.int64)

    @classmethod
    def load(cls, path: str) -> ByteVocabulary:
        import tokenizers

        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        special = {entry["content"] for entry in model["added_tokens"]}
        entries, letters = model["model"]["vocab"], byte_letters()
        own = {bytes(map(letters.__getitem__, entry)): i for entry, i in entries.items() if entry not in special}
        texts = [b""] * (max(entries.values()) + 1)
        for entry, i in own.items():
            texts[i] = entry
        found = cls(texts)
        merges = [pair.split(" ") if isinstance(pair, str) else pair for pair in model["model"]["merges"]]
        ranked = [entries["".join(pair)] for pair in merges]
        if ranked == sorted(ranked) and len(set(ranked)) == len(ranked):
            # Ids follow the order of the merges: merging by rank gives the same tokens, and faster.
            import tiktoken

            ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own, special_tokens={})
            found._encode = ranks.encode_ordinary
        else:
            library = tokenizers.Tokenizer.from_file(path)
            library.encode_special_tokens = True
            found._encode = lambda text: library.encode(text, add_special_tokens=False).ids
        return found

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(self._encode(text), np.int64) for text in texts]


class _Numbers(dict):
    """Words by the order in which they were first asked for."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


class PieceVocabulary:
    """A SentencePiece vocabulary; marks are spaces, byte pieces their byte.

    Where no piece has a mark behind another character, merges stay inside marked words, and each distinct word
    is encoded once and remembered; other vocabularies and texts with marks of their own are encoded whole.
    """

    REMEMBERED = 200_000
    _WORD = re.compile(r" *[^ ]+| +")

    def __init__(self, model):
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.texts = [
            bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace(MARK, " ").encode()
            for i, piece in enumerate(pieces)
        ]
        self.sizes = np.array([len(text) for text in self.texts], np.int64)
        self._model = model
        self._by_word = MARK in pieces and all(MARK not in piece.lstrip(MARK) for piece in pieces)
        self._mark = model.piece_to_id(MARK)
        self._forget()

    @classmethod
    def load(cls, path: str) -> PieceVocabulary:
        import sentencepiece

        return cls(sentencepiece.SentencePieceProcessor(model_file=path))

    def _forget(self) -> None:
        self._number = _Numbers()
        self._ids = np.zeros(0, np.int32)
        self._begin, self._size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self._number) > self.REMEMBERED:
            self._forget()
        known = self._number.__getitem__
        held = []
        for text in texts:
            whole = not self._by_word or MARK in text
            words = [] if whole else self._WORD.findall(f" {text}")
            held.append(text if whole else np.fromiter(map(known, words), np.int64, len(words)))
        self._learn(list(itertools.islice(self._number, len(self._size), None)))
        return [self._joined(words) if isinstance(words, np.ndarray) else self._whole(words) for words in held]

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self._model.encode(text, num_threads=1), np.int64)

    def _learn(self, words: list[str]) -> None:
        # The library adds the first mark itself, but not to an empty text.
        found = self._model.encode([word[1:] for word in words], num_threads=1) if words else []
        found = [[self._mark] if word == " " else ids for word, ids in zip(words, found)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self._begin = np.concatenate([self._begin, len(self._ids) + np.cumsum(sizes) - sizes])
        self._size = np.concatenate([self._size, sizes])
        more = np.fromiter(itertools.chain.from_iterable(found), np.int32, int(sizes.sum()))
        self._ids = np.concatenate([self._ids, more])

    def _joined(self, words: np.ndarray) -> np.ndarray:
        sizes = self._size[words]
        return self._ids[np.repeat(self._begin[words], sizes) + _runs(sizes)].astype(np.int64)


@functools.cache
def vocabularies(byte_model: str, piece_model: str) -> tuple[ByteVocabulary, PieceVocabulary]:
    """Loaded once per worker."""
    return ByteVocabulary.load(byte_model), PieceVocabulary.load(piece_model)


def gallop(ends: np.ndarray, into: np.ndarray, start: np.ndarray) -> np.ndarray:
    """How many entries of ``into`` are <= each end, if the first ``start`` of them are known to be."""
    found, step = start.copy(), np.ones(len(ends), np.int64)
    open_ = np.arange(len(ends))
    while len(open_):
        probe = found[open_] + step[open_] - 1
        inside = probe < len(into)
        passed = inside.copy()
        passed[inside] = into[probe[inside]] <= ends[open_[inside]]
        open_ = open_[passed]
        found[open_] += step[open_]
        step[open_] *= 2
    # Between found and found + step - 1 there is an entry beyond the end, or the list's own end.
    beyond = np.minimum(found + step - 1, len(into))
    open_ = np.flatnonzero(found < beyond)
    while len(open_):
        middle = (found[open_] + beyond[open_]) // 2
        less = into[middle] <= ends[open_]
        found[open_[less]] = middle[less] + 1
        beyond[open_[~less]] = middle[~less]
        open_ = open_[found[open_] < beyond[open_]]
    return found


def ranks(ends: np.ndarray, into: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The rank of each end in ``into``; ``before``: entries of ``into`` in front of the end's document.

    Every ``FOLLOWERS``-th end leads from the start of its document; the others start at their leader's place.
    """
    found = np.empty(len(ends), np.int64)
    leaders = np.arange(0, len(ends), FOLLOWERS)
    found[leaders] = gallop(ends[leaders], into, before[leaders])
    rest = np.flatnonzero(np.arange(len(ends)) % FOLLOWERS)
    led = found[rest // FOLLOWERS * FOLLOWERS]
    found[rest] = gallop(ends[rest], into, np.maximum(led, before[rest]))
    return found


@dataclass
class Alignment:
    """Tokens of several documents in a row. ``first`` and ``number``: the tokens of the other list each driving
    token overlaps. ``group`` and ``other_group``: groups counted through all documents."""

    first: np.ndarray
    number: np.ndarray
    group: np.ndarray
    other_group: np.ndarray
    groups: np.ndarray  # per document


def align(sizes: list[np.ndarray], other_sizes: list[np.ndarray]) -> Alignment:
    """Documents given by the byte sizes of their tokens, the driving and shorter list first. Both lists of a
    document have the same sum, and no document is empty."""
    ends, into = np.cumsum(np.concatenate(sizes)), np.cumsum(np.concatenate(other_sizes))
    counts, other_counts = np.array([*map(len, sizes)]), np.array([*map(len, other_sizes)])
    before = np.repeat(np.cumsum(other_counts) - other_counts, counts)
    rank = ranks(ends, into, before)
    common = into[rank - 1] == ends
    common &= rank > 0
    first = np.concatenate([[0], rank[:-1]])
    number = rank - common - first + 1
    cut = np.zeros(len(into), np.int64)
    cut[rank[common] - 1] = 1
    return Alignment(
        first,
        number,
        np.cumsum(common) - common,
        np.cumsum(cut) - cut,
        np.add.reduceat(common.astype(np.int64), np.cumsum(counts) - counts),
    )


def _runs(sizes: np.ndarray) -> np.ndarray:
    """0..n-1 for each n in turn."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


@dataclass
class Aligned:
    """One document's alignment."""

    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    n_links: int = 0
    groups: str = ""
    pairs: np.ndarray | None = None
    times: np.ndarray | None = None


class Aligner:
    def __init__(self, a: ByteVocabulary, b: PieceVocabulary):
        self.a, self.b = a, b
        self.width = len(b.texts)  # a pair of ids is a * width + b
        # Each id as it stands in the text of groups: followed by the next of its list, or at a list's end.
        self.spelt = [
            *(f"{i}," for i in range(len(a.texts))),
            *(f"{i}|" for i in range(len(a.texts))),
            *(f"{i}," for i in range(len(b.texts))),
            *(f"{i};" for i in range(len(b.texts))),
        ]

    def align(self, texts: list[str | None]) -> list[Aligned]:
        given = [f" {text}" if text else "" for text in texts]
        held = [i for i, text in enumerate(given) if text]
        ids_a, ids_b = self.a.encode([given[i] for i in held]), self.b.encode([given[i][1:] for i in held])
        out = [Aligned() for _ in texts]
        a_first, b_first = [], []
        for i, a, b in zip(held, ids_a, ids_b):
            whole = given[i].encode()
            # The first encoding only joins bytes of the text, so its size tells whether it is all of them.
            if int(self.a.sizes[a].sum()) == len(whole) and self._bytes(b) == whole:
                (a_first if len(a) <= len(b) else b_first).append((out[i], a, b))
        for rows, drives in ((a_first, True), (b_first, False)):
            if rows:
                self._fill(rows, drives)
        return out

    def _bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.b.texts.__getitem__, ids.tolist()))

    def _fill(self, rows: list[tuple[Aligned, np.ndarray, np.ndarray]], a_drives: bool) -> None:
        ids = [[a for _, a, _ in rows], [b for _, _, b in rows]]
        sizes = [[self.a.sizes[a] for a in ids[0]], [self.b.sizes[b] for b in ids[1]]]
        flat_a, flat_b = np.concatenate(ids[0]), np.concatenate(ids[1])
        found = align(sizes[0], sizes[1]) if a_drives else align(sizes[1], sizes[0])
        driver, other = (flat_a, flat_b) if a_drives else (flat_b, flat_a)
        reached = other[np.repeat(found.first, found.number) + _runs(found.number)]
        from_ = np.repeat(driver, found.number)
        pairs = from_ * self.width + reached if a_drives else reached * self.width + from_
        counts = np.array([len(a) if a_drives else len(b) for _, a, b in rows])
        document = np.repeat(np.repeat(np.arange(len(rows)), counts), found.number)
        self._spell(rows, flat_a, flat_b, *((found.group, found.other_group) if a_drives else (found.other_group, found.group)))
        links = np.bincount(document, minlength=len(rows))
        # The pairs of each document in order, each once with its number of links.
        span = len(self.a.texts) * self.width
        placed = np.sort(document * span + pairs)
        at = np.flatnonzero(np.concatenate([[True], placed[1:] != placed[:-1]]))
        times = np.diff(np.append(at, len(placed)))
        document, pairs = np.divmod(placed[at], span)
        cuts = np.searchsorted(document, np.arange(len(rows) + 1))
        for k, (row, a, b) in enumerate(rows):
            row.n_a, row.n_b, row.n_groups, row.n_links = len(a), len(b), int(found.groups[k]), int(links[k])
            row.pairs, row.times = pairs[cuts[k] : cuts[k + 1]], times[cuts[k] : cuts[k + 1]]

    def _spell(self, rows, flat_a, flat_b, group_a, group_b) -> None:
        """The groups of each document as text: ids of a by commas, |, ids of b, and ; between groups."""
        last_a, last_b = np.ones(len(group_a), bool), np.ones(len(group_b), bool)
        last_a[:-1] = group_a[1:] != group_a[:-1]
        last_b[:-1] = group_b[1:] != group_b[:-1]
        size_a, size_b = len(self.a.texts), len(self.b.texts)
        codes = np.concatenate([flat_a + last_a * size_a, 2 * size_a + flat_b + last_b * size_b])
        # Tokens of a group's first list come before those of its second.
        codes = codes[np.argsort(np.concatenate([group_a * 2, group_b * 2 + 1]), kind="stable")].tolist()
        at, spelt = 0, self.spelt.__getitem__
        for row, a, b in rows:
            row.groups = "".join(map(spelt, codes[at : at + len(a) + len(b)]))[:-1]
            at += len(a) + len(b)


def aligned(docs: DataFrame, byte_model: str = BYTE_MODEL, piece_model: str = PIECE_MODEL) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and its linked pairs of ids with their numbers of links.

    A pair is one number, the first id times the second vocabulary's size plus the second id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*vocabularies(byte_model, piece_model))
        for batch in batches:
            for part in chunks(batch, "text", TOGETHER):
                rows = aligner.align(part.column("text").to_pylist())
                none = np.zeros(0, np.int64)
                pairs = [none if row.pairs is None else row.pairs for row in rows]
                times = [none if row.times is None else row.times for row in rows]
                cuts = pa.array(np.cumsum([0, *map(len, pairs)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        *(pa.array([getattr(row, name) for row in rows], pa.int64()) for name in ("n_a", "n_b", "n_groups", "n_links")),
                        pa.array([hashlib.sha256(row.groups.encode()).hexdigest() if row.n_a else "" for row in rows]),
                        pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(pairs), pa.int64())),
                        pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(times), pa.int32())),
                    ],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
                )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, ALIGNED)


def groups_of(text: str | None, byte_model: str = BYTE_MODEL, piece_model: str = PIECE_MODEL) -> str:
    """The groups of one text, as they are hashed."""
    return Aligner(*vocabularies(byte_model, piece_model)).align([text])[0].groups


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, docs): the number of rows of ``aligned`` that hold each linked pair of ids."""
    return rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("docs"))


def _stored(rows: DataFrame, label: str) -> DataFrame:
    """Written once to the shared folder, well packed: lists of pairs are most of what is kept."""
    path = scratch_path(rows.sparkSession, label)
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def scored(rows: DataFrame, width: int, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """``aligned`` rows, read from storage, with n_best and count_sum from the counts of all rows.

    ``width`` is the size of the second vocabulary.
    """
    counts = _stored(pair_counts(rows), "pair-counts")
    highest = counts.groupBy(F.expr(f"pair div {width}").alias("a")).agg(F.max("docs").alias("most"))
    known = counts.join(highest, F.expr(f"pair div {width}") == F.col("a")).select(
        "pair", "docs", (F.col("docs") == F.col("most")).alias("best")
    )
    known = _stored(known, "pair-scores")
    totals = counts.agg(F.count(F.lit(1)).alias("pairs"), F.sum("docs").alias("links")).first()
    # Pairs in at least so many rows are no more than hot_pairs, since their counts add up to at most all links.
    least = 1 if totals.pairs <= hot_pairs else -(-totals.links // hot_pairs)

    links = rows.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select(
        "_row", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times")
    )
    hot = F.broadcast(known.where(F.col("docs") >= least))
    met = links.join(hot, "pair")
    if least > 1:
        cold = known.where(F.col("docs") < least)
        met = met.unionByName(links.join(hot.select("pair"), "pair", "left_anti").join(cold.hint("merge"), "pair"))
    sums = met.groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("docs") * F.col("times")).alias("count_sum"),
    )
    return rows.drop("pairs", "times").join(sums, "_row", "left").fillna(0, ["n_best", "count_sum"])


def alignment_scores(
    docs: DataFrame, byte_model: str = BYTE_MODEL, piece_model: str = PIECE_MODEL, hot_pairs: int = HOT_PAIRS
) -> DataFrame:
    rows = aligned(docs, byte_model, piece_model).withColumn("_row", F.monotonically_increasing_id())
    width = len(PieceVocabulary.load(piece_model).texts)
    return scored(_stored(rows, "alignment"), width, hot_pairs).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_scores(source(spark, sf_dir, "documents"))
