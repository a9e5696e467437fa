"""Byte-level BPE encoding and decoding by two-tier lookup.

A text is cut into pre-tokens by the vocabulary's pattern. The distinct pre-tokens of a task are
looked up once: a minimal perfect hash over the vocabulary names the only entry a pre-token can
be, one comparison tells whether it is, and its id is the answer. What misses is merged from its
bytes: the pieces form a linked list, a heap gives the adjacent pair of least rank, leftmost first,
and pairs that a merge has made stale are skipped when they come up. Ids are those of the tiktoken
library, which also takes a pre-token of the vocabulary whole.

The pattern's letter, number and space classes are the library's own: where this Python's classes
differ (other versions of Unicode), texts that hold such characters are cut by a corrected pattern.

Defined cases: null has no ids and decodes to null, an empty text has no ids; in ``digests`` both
count as empty. Rows are independent, so repeated rows, ties and empty tables need nothing; ``digests``
returns the id it is told to carry and its own columns, so extra columns of any name do not clash.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import itertools
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from courtside.llm.shared import chunks, source

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
# Distinct pre-tokens a worker remembers before it starts anew.
REMEMBERED = 300_000
# Texts of more characters are cut one pre-token at a time, so that no list of them is held.
LONG_TEXT = 1 << 20
# Bytes of text taken together.
TOGETHER = 4 << 20
# Displacements tried for a bucket before all is placed anew with another seed.
MOST_TRIED = 1 << 16


class PerfectHash:
    """A minimal perfect hash over byte strings by hashing and displacing: n keys fill n slots."""

    def __init__(self, keys: list[bytes]):
        self.size = max(len(keys), 1)
        self.buckets = len(keys) // 3 + 1
        for self.seed in itertools.count(1):
            placed = self._place(keys)
            if placed is not None:
                break
        self.displacement, self.slot_of_key = placed

    def _place(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """Bucket by bucket, the largest first, the first displacement that sends its keys to free slots."""
        hashes = self.hashes(keys)
        bucket = self._bucket(hashes)
        displacement, slots = np.zeros(self.buckets, np.int64), np.zeros(len(keys), np.int64)
        free = np.ones(self.size, bool)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        begins = np.cumsum(sizes) - sizes
        for b in np.argsort(-sizes, kind="stable"):
            if sizes[b] < 2:
                break
            held = order[begins[b] : begins[b] + sizes[b]]
            for first in range(0, MOST_TRIED, 256):
                at = self._moved(hashes[held][:, None], np.arange(first, first + 256))
                fits = np.flatnonzero(free[at].all(axis=0))
                good = next((g for g in fits.tolist() if len(set(at[:, g].tolist())) == len(held)), None)
                if good is not None:
                    displacement[b], slots[held] = first + good, at[:, good]
                    free[at[:, good]] = False
                    break
            else:
                return None
        # Buckets of one key take what is left, named outright.
        alone = order[begins[sizes == 1]]
        left = np.flatnonzero(free)[: len(alone)]
        displacement[bucket[alone]], slots[alone] = -1 - left, left
        return displacement, slots

    def hashes(self, keys: list[bytes]) -> np.ndarray:
        digest, seed = xxhash.xxh64_intdigest, self.seed
        return np.fromiter((digest(key, seed) for key in keys), np.uint64, len(keys))

    def _bucket(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)

    def _moved(self, hashes: np.ndarray, displacement: np.ndarray) -> np.ndarray:
        mixed = hashes + displacement.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(self.size)).astype(np.int64)

    def slots(self, keys: list[bytes]) -> np.ndarray:
        """The one slot each string can stand in; strings that are no keys get some slot as well."""
        hashes = self.hashes(keys)
        moved = self.displacement[self._bucket(hashes)]
        return np.where(moved < 0, -1 - moved, self._moved(hashes, np.maximum(moved, 0)))


class BytePairs:
    """A vocabulary of byte strings by rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.texts = [b""] * (max(ranks.values(), default=-1) + 1)
        for entry, rank in ranks.items():
            self.texts[rank] = entry
        entries = list(ranks)
        self.whole = PerfectHash(entries)
        self.entry_at, self.rank_at = [b""] * self.whole.size, np.zeros(self.whole.size, np.int64)
        for entry, slot in zip(entries, self.whole.slot_of_key.tolist()):
            self.entry_at[slot], self.rank_at[slot] = entry, ranks[entry]
        self.cut = PreTokens(pattern)

    @classmethod
    def load(cls, path: str = RANKS, pattern: str = PATTERN) -> BytePairs:
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        return cls({base64.b64decode(entry): int(rank) for entry, rank in pairs}, pattern)

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of whole pre-tokens by the perfect hash, of the others by merges."""
        if not words:
            return []
        slots = self.whole.slots(words)
        ids, entry_at = self.rank_at[slots].tolist(), self.entry_at
        return [
            [rank] if entry_at[slot] == word else self.merge(word) for word, slot, rank in zip(words, slots.tolist(), ids)
        ]

    def merge(self, word: bytes) -> list[int]:
        """Merges the adjacent pieces of least rank until no pair is in the vocabulary."""
        ranks, size = self.ranks, len(word)
        # By the first byte of a piece: where it ends, and where the piece before it begins.
        end, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = []
        for at in range(size - 1):
            rank = ranks.get(word[at : at + 2])
            if rank is not None:
                heap.append((rank, at, at + 1, at + 2))
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            _, left, middle, right = pop(heap)
            if end[left] != middle or end[middle] != right:
                continue
            end[left], end[middle] = right, 0
            if right < size:
                before[right] = left
                rank = ranks.get(word[left : end[right]])
                if rank is not None:
                    push(heap, (rank, left, right, end[right]))
            first = before[left]
            if first >= 0:
                rank = ranks.get(word[first:right])
                if rank is not None:
                    push(heap, (rank, first, left, right))
        out, at = [], 0
        while at < size:
            out.append(ranks[word[at : end[at]]])
            at = end[at]
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.texts.__getitem__, ids))


class PreTokens:
    """Cuts texts by a pattern whose classes are those of the tiktoken library."""

    CLASSES = (r"\p{L}", r"\p{N}", r"\s")

    def __init__(self, pattern: str = PATTERN):
        self.plain = regex.compile(pattern)
        changes = {name: _class_changes(name) for name in self.CLASSES if name in pattern}
        odd = sorted({c for gone, more in changes.values() for c in (*gone, *more)})
        self.odd = re.compile(_ranges(odd)) if odd else None
        for name, (gone, more) in changes.items():
            own = f"[{name}--{_ranges(gone)}]" if gone else name
            own = f"[{own}||{_ranges(more)}]" if more else own
            pattern = pattern.replace(name, own)
        self.exact = regex.compile(f"(?V1){pattern}") if odd else self.plain

    def of(self, text: str) -> Iterator[str]:
        found = self.exact if self.odd and not text.isascii() and self.odd.search(text) else self.plain
        if len(text) > LONG_TEXT:
            return (match.group() for match in found.finditer(text))
        return iter(found.findall(text))


@functools.cache
def _class_changes(name: str) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Code points in this Python's class and not in the library's, and the other way round."""
    import tiktoken

    every = "".join(map(chr, itertools.chain(range(0xD800), range(0xE000, 0x110000))))
    bytewise = tiktoken.Encoding(
        "class", pat_str=name, mergeable_ranks={bytes([value]): value for value in range(256)}, special_tokens={}
    )
    theirs = set(bytes(bytewise.encode_ordinary(every)).decode())
    ours = set(regex.findall(name, every))
    return tuple(sorted(map(ord, ours - theirs))), tuple(sorted(map(ord, theirs - ours)))


def _ranges(points: tuple[int, ...] | list[int]) -> str:
    """A character class of sorted code points."""
    out, points = [], list(points)
    for _, run in itertools.groupby(enumerate(points), lambda pair: pair[1] - pair[0]):
        held = [point for _, point in run]
        out.append(f"\\U{held[0]:08x}" + (f"-\\U{held[-1]:08x}" if len(held) > 1 else ""))
    return f"[{''.join(out)}]"


class Encoder:
    """Encodes texts, remembering the ids of the pre-tokens seen so far."""

    def __init__(self, vocabulary: BytePairs):
        self.vocabulary = vocabulary
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Ids of each text as int32; None for None."""
        if len(self.number) > REMEMBERED:
            self._forget()
        number, cut = self.number, self.vocabulary.cut.of
        held = [
            None if text is None else np.fromiter((number.setdefault(word, len(number)) for word in cut(text)), np.int64)
            for text in texts
        ]
        self._learn(list(itertools.islice(number, len(self.size), None)))
        return [None if words is None else self._joined(words) for words in held]

    def _learn(self, words: list[str]) -> None:
        found = self.vocabulary.encode_words([word.encode() for word in words])
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        more = np.fromiter(itertools.chain.from_iterable(found), np.int32, int(sizes.sum()))
        self.ids = np.concatenate([self.ids, more])

    def _joined(self, words: np.ndarray) -> np.ndarray:
        sizes = self.size[words]
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.begin[words] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


@functools.cache
def vocabulary_at(path: str, pattern: str) -> BytePairs:
    """Loaded once per worker."""
    return BytePairs.load(path, pattern)


def _slices(values: pa.Array) -> Iterator[pa.Array]:
    """Pieces of an array of texts holding about TOGETHER bytes each."""
    for part in chunks(pa.RecordBatch.from_arrays([values.cast(pa.string())], names=["text"]), "text", TOGETHER):
        yield part.column(0)


def encode_column(text: Column | str, path: str = RANKS, pattern: str = PATTERN) -> Column:
    """The ids of each text as array<int>."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(vocabulary_at(path, pattern))
        for texts in batches:
            found = [pa.array(encoder.encode(part.to_pylist()), pa.list_(pa.int32())) for part in _slices(texts)]
            yield pa.concat_arrays(found) if found else pa.array([], pa.list_(pa.int32()))

    return encode(text)


def decode_column(ids: Column | str, path: str = RANKS, pattern: str = PATTERN) -> Column:
    """The bytes that ids stand for; those of a whole encoded text are its UTF-8."""

    @F.arrow_udf(T.BinaryType())
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = vocabulary_at(path, pattern)
        for rows in batches:
            yield pa.array([None if row is None else vocabulary.decode(row) for row in rows.to_pylist()], pa.binary())

    return decode(ids)


def digests(docs: DataFrame, key: str = "doc_id", path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """Per row: the key, n_tokens, and the SHA-256 of the ids and of their decoding, as lowercase hex."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary_at(path, pattern))
        for batch in batches:
            for part in chunks(batch, "text", TOGETHER):
                found = encoder.encode([text or "" for text in part.column("text").to_pylist()])
                decoded = (encoder.vocabulary.decode(ids.tolist()) for ids in found)
                columns = [
                    part.column("key"),
                    pa.array([len(ids) for ids in found], pa.int64()),
                    pa.array([hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest() for ids in found], pa.string()),
                    pa.array([hashlib.sha256(text).hexdigest() for text in decoded], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(key).alias("key"), F.col("text").cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(encode, f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(source(spark, sf_dir, "documents"))
