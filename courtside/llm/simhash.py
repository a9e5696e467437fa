"""SimHash near-dedup by Golay-code fuzzy hashing.

The 64 bits of a fingerprint are cut into three segments of 22, 21 and 21 bits. At most four
differing bits leave some two of the segments with at most two differences between them
(their three sums add up to eight). Each segment is decoded with the perfect binary Golay code
of 23 bits: a word is given the indices of all codewords within four bits of it, one or six of
them. Two words that differ in at most two bits share an index, since a word halfway between
them lies within three bits of some codeword, which is then within four bits of both. So two
fingerprints that link share a key (pair of segments, index, index); rows meet by key and the
bit distance decides. Equal fingerprints are one item from the start.

Defined cases: null text and text without a word have fingerprint zero and link like any other;
component_id is the smallest non-null doc_id of the component (null if it has none); repeated
rows belong to one component; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from courtside.llm.linking import components, group_links, sorted_groups, spread_groups
from courtside.llm.shared import fresh, shuffle_partitions, source
from courtside.workspace import staged

SHINGLE = 4
REACH = 4
SEED = 42
SEGMENTS = ((42, 22), (21, 21), (0, 21))  # (lowest bit, bits)

# Generator polynomial of the binary Golay code of 23 bits.
_GENERATOR, _LENGTH, _CHECKS = 0b110001110101, 23, 11


def _remainder(word: int) -> int:
    for bit in range(_LENGTH - 1, _CHECKS - 1, -1):
        if word >> bit & 1:
            word ^= _GENERATOR << (bit - _CHECKS)
    return word


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of single bits by byte; per syndrome the nearest error, its weight, and the errors of weight four."""
    single = [_remainder(1 << bit) for bit in range(_LENGTH)]
    by_byte = np.zeros((3, 256), dtype=np.uint32)
    for byte in range(3):
        for value in range(256):
            for bit in range(8):
                if value >> bit & 1 and byte * 8 + bit < _LENGTH:
                    by_byte[byte, value] ^= single[byte * 8 + bit]
    nearest = np.zeros(1 << _CHECKS, dtype=np.uint32)
    weight = np.zeros(1 << _CHECKS, dtype=np.uint8)
    four = np.zeros((1 << _CHECKS, 5), dtype=np.uint32)
    filled = [0] * (1 << _CHECKS)
    for size in (1, 2, 3, 4):
        for bits in combinations(range(_LENGTH), size):
            syndrome, error = 0, 0
            for bit in bits:
                syndrome ^= single[bit]
                error |= 1 << bit
            if size < 4:
                nearest[syndrome], weight[syndrome] = error, size
            else:
                four[syndrome, filled[syndrome]] = error
                filled[syndrome] += 1
    return by_byte, nearest, weight, four


_BY_BYTE, _NEAREST, _WEIGHT, _FOUR = _tables()


def codeword_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n x 6 indices, how many of them count) of the codewords within four bits of each word."""
    words = words.astype(np.uint32)
    syndrome = _BY_BYTE[0, words & 255] ^ _BY_BYTE[1, words >> 8 & 255] ^ _BY_BYTE[2, words >> 16]
    errors = np.concatenate((_NEAREST[syndrome][:, None], _FOUR[syndrome]), axis=1)
    return (words[:, None] ^ errors) >> _CHECKS, np.where(_WEIGHT[syndrome] == 3, 6, 1)


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): keys that any two fingerprints within four bits have one of in common."""
    indices, counts = zip(
        *[codeword_indices((prints >> np.uint64(low)) & np.uint64((1 << bits) - 1)) for low, bits in SEGMENTS]
    )
    rows, keys = [], []
    slots = np.arange(6)
    for number, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        used = (slots < counts[a][:, None])[:, :, None] & (slots < counts[b][:, None])[:, None, :]
        both = (indices[a].astype(np.int64)[:, :, None] << 12) | indices[b].astype(np.int64)[:, None, :]
        row, i, j = np.nonzero(used)
        rows.append(row)
        keys.append(both[row, i, j] | (number << 24))
    return np.concatenate(rows), np.concatenate(keys)


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Of UTF-8 text. On bytes, lower() changes A-Z only and split() knows ASCII white space only."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    take = min(shingle, len(words))
    count = len(words) - take + 1
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[:count].tolist(), (ends[take - 1 :] - 1).tolist())
    codes = np.fromiter((digest(joined[a:b], SEED) for a, b in pairs), dtype=np.uint64, count=count)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, count, 1 << 16):  # long texts piece by piece
        bits = np.unpackbits(codes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, row_hash, print): the fingerprint as a signed number."""

    @F.arrow_udf("bigint")
    def prints(texts: pa.Array) -> pa.Array:
        found = np.array([fingerprint(text.as_py(), shingle) for text in texts.cast(pa.binary())], dtype=np.uint64)
        return pa.array(found.view(np.int64))

    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("row_hash"), prints("text").alias("print")
    )


def fingerprint_links(prints: DataFrame, reach: int = REACH) -> DataFrame:
    """(a, b): per key a spanning forest of the links between distinct fingerprints."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                values = batch.column("print").slice(at, 2048).to_numpy(zero_copy_only=False)
                rows, keys = fuzzy_keys(values.view(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.astype(np.int32)), pa.array(values[rows])], names=["key", "print"]
                )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[tuple[int, int]] = set()
        for table in sorted_groups(batches, "group"):
            values = table["print"].to_numpy()
            left, right = group_links(table["group"].to_numpy(), values.view(np.uint64), reach)
            found = set(zip(values[left].tolist(), values[right].tolist())) - known
            if len(known) > 500_000:  # links already given, remembered up to here
                known.clear()
            known |= found
            pairs = sorted(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"]
            )

    if reach > REACH:
        raise ValueError(f"the keys hold for at most {REACH} differing bits")
    tasks = shuffle_partitions(prints.sparkSession)
    keyed = prints.select("print").mapInArrow(expand, "key int, print bigint")
    grouped = spread_groups(keyed, "key", "print").select("group", "print")
    met = grouped.repartition(tasks, "group").sortWithinPartitions("group", "print")
    return met.mapInArrow(search, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, reach: int = REACH) -> DataFrame:
    """(doc_id, row_hash, print, root, component_id) per row of ``docs``; root names the component."""
    prints = staged(with_fingerprints(docs, shingle), "prints")
    classes = staged(prints.groupBy("print").agg(F.min("doc_id").alias("first")), "print-classes")
    roots = components(fingerprint_links(classes, reach), "prints")
    labelled = classes.join(roots, F.col("print") == F.col("node"), "left").select(
        "print", "first", F.coalesce("root", "print").alias("root")
    )
    smallest = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    labelled = labelled.join(smallest, "root").select("print", "root", "component_id")
    return prints.join(labelled, "print").select("doc_id", "row_hash", "print", "root", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(source(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: of smallest id, then smallest hash of its text.

    Of rows that agree in id and text one stays. Components without any id keep one row.
    """
    found = staged(near_duplicates(docs), "near-duplicates")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "row_hash")
    kept = found.groupBy("root").agg(F.min(place).alias("kept")).select("kept.doc_id", "kept.row_hash").distinct()
    kept_id, kept_hash, row_hash = fresh(docs, "_kept_id", "_kept_hash", "_row_hash")
    kept = kept.select(F.col("doc_id").alias(kept_id), F.col("row_hash").alias(kept_hash))
    marked = docs.withColumn(row_hash, F.xxhash64("text"))
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col(kept_id)) & (F.col(row_hash) == F.col(kept_hash))
    chosen = marked.join(kept, same, "left_semi")
    # Rows that agree in id and text cannot be told apart by the join.
    repeated = found.groupBy("doc_id", "row_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not repeated.isEmpty():
        chosen = chosen.dropDuplicates(["doc_id", row_hash])
    return chosen.drop(row_hash)
