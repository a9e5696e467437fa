"""Line dedup: near-equal lines across all documents, one occurrence kept per connected group.

A line is normalised to its lower-cased words, ASCII punctuation left out and digits written as 0. Lines of one normalised
form are equal. Two forms are linked when their SimHash fingerprints differ in at most
``REACH`` bits and their edit similarity, 1 - distance / longer length, is ``SIMILARITY`` or
more. Of each connected group the first line stays, by document id and then line number;
the others are cut out of their documents.

Fingerprints are over words of four bytes or more (over all words of a line that has none), since the
few short words of a language would make unrelated lines alike. They have 60 bits in four blocks of 15. Two that differ in at most three bits agree in
a block, so rows sorted by (block number, block value, the other bits) bring every pair together.

Defined cases: null text stays null, with no lines; lines without a word are never removed; a
document whose lines all go keeps its row with an empty text; repeated rows are separate
documents, told apart by their text's hash and, where that is equal too, both lose the same lines
except those kept by their common id; an empty table gives an empty table; other columns pass
through and ``n_chars``, where there is one, is counted anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from courtside.llm import linetext
from courtside.llm.linking import MATRIX, components, runs, sorted_groups, spanning_links, spread_groups
from courtside.llm.shared import chunks, fresh, shuffle_partitions, source
from courtside.workspace import staged

REACH = 3
SIMILARITY = 0.8
BLOCKS, BLOCK_BITS = 4, 15
BITS = linetext.BITS
# The filter that preselects lines to fetch: fixed at 2^25 bits (4 MB), whatever the input.
FILTER_BITS = 25
# Groups of this many forms are large, or of more where that would make more than MOST_LARGE of them.
LARGE_GROUP, MOST_LARGE = 100, 10_000

def read_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, row_hash, line_no, form, print) for every line with a word."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", 2 << 20):
                for lines in linetext.read_lines(part.column("text").to_pylist()):
                    at = pa.array(lines.rows)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(at), part.column("row_hash").take(at), pa.array(lines.numbers, pa.int32()),
                         pa.array(lines.forms.view(np.int64)), pa.array(lines.prints.view(np.int64))],
                        names=["doc_id", "row_hash", "line_no", "form", "print"],
                    )

    rows = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("row_hash"), "text")
    return rows.mapInArrow(read, "doc_id bigint, row_hash bigint, line_no int, form bigint, print bigint")


def rotated(prints: np.ndarray, block: int) -> np.ndarray:
    """Block number, then the fingerprint turned so that this block leads. Keeps every bit."""
    turn = np.uint64(block * BLOCK_BITS)
    rest = np.uint64(BITS - block * BLOCK_BITS)
    mask = np.uint64((1 << BITS) - 1)
    turned = ((prints << turn) | (prints >> rest)) & mask if block else prints
    return (np.uint64(block) << np.uint64(BITS)) | turned


def _spread_keys(forms: DataFrame) -> DataFrame:
    """(group, bucket, key, form): one row per block, sorted within tasks by group and key."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column("print").to_numpy(zero_copy_only=False).view(np.uint64)
            keys = np.concatenate([rotated(prints, block) for block in range(BLOCKS)])
            forms = pa.concat_arrays([batch.column("form")] * BLOCKS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), forms], names=["key", "form"])

    keyed = forms.select("form", "print").mapInArrow(expand, "key bigint, form bigint")
    keyed = keyed.withColumn("bucket", F.shiftright("key", BITS - BLOCK_BITS).cast("int"))
    tasks = shuffle_partitions(forms.sparkSession)
    return spread_groups(keyed, "bucket", "form").repartition(tasks, "group").sortWithinPartitions("group", "key")


def has_neighbour(keys: np.ndarray) -> np.ndarray:
    """Which of the sorted fingerprints of one bucket have another within reach.

    A large bucket is cut into narrower ones: the bits outside the shared block hold at most
    three differences, so of four parts of them one is equal, and only rows equal in it are compared.
    """
    n = len(keys)
    if n <= MATRIX:
        return (np.bitwise_count(keys[:, None] ^ keys[None, :]) <= REACH).sum(axis=1) > 1
    found = np.zeros(n, dtype=bool)
    free = BITS - BLOCK_BITS
    for part in range(4):
        low, high = part * free // 4, (part + 1) * free // 4
        value = (keys >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)
        order = np.argsort(value, kind="stable")
        starts, sizes = runs(value[order])
        for start, size in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
            group = order[start : start + size]
            ranked = keys[group]
            if size <= MATRIX:
                close = np.bitwise_count(ranked[:, None] ^ ranked[None, :]) <= REACH
                found[group[close.sum(axis=1) > 1]] = True
                continue
            # Neighbours in sorted order settle most of a dense group; the rest is compared with all.
            near = np.bitwise_count(ranked[1:] ^ ranked[:-1]) <= REACH
            found[group[np.concatenate((near, [False])) | np.concatenate(([False], near))]] = True
            for one in group[~found[group]].tolist():
                close = np.bitwise_count(keys[one] ^ ranked) <= REACH
                if close.sum() > 1:
                    found[group[close]] = True
    return found


def _candidates(forms: DataFrame) -> DataFrame:
    """(bucket, form, print) of forms that have another form within reach in the bucket."""
    mask = np.uint64((1 << BITS) - 1)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, "group"):
            buckets = table["bucket"].to_numpy()
            keys = table["key"].to_numpy().view(np.uint64) & mask
            found = np.zeros(len(keys), dtype=bool)
            starts, sizes = runs(table["group"].to_numpy())
            for start, size in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
                found[start : start + size] = has_neighbour(keys[start : start + size])
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(buckets[at]), table["form"].combine_chunks().take(pa.array(at)) if len(at) else pa.array([], pa.int64()),
                 pa.array(keys[at].view(np.int64))],
                names=["bucket", "form", "turned"],
            )

    # A row of a key that was cut into blocks may be found in several of its groups.
    return _spread_keys(forms).mapInArrow(search, "bucket int, form bigint, turned bigint").distinct()


def _shared(a: str, b: str) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def edit_distance(a: str, b: str, most: int | None = None) -> int:
    """Levenshtein distance, one whole column of the table per step in the bits of one integer.

    What both have in common at their ends is left out first. With ``most`` the work ends as soon
    as the distance is known to be larger; some number above ``most`` is then given.
    """
    at = _shared(a, b)
    a, b = a[at:], b[at:]
    at = _shared(a[::-1], b[::-1])
    a, b = a[: len(a) - at], b[: len(b) - at]
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    where: dict[str, int] = {}
    for i, char in enumerate(a):
        where[char] = where.get(char, 0) | (1 << i)
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    rising, falling, distance = full, 0, len(a)
    most, left = len(b) if most is None else most, len(b)
    for char in b:
        if distance - left > most:
            return distance - left
        left -= 1
        same = where.get(char, 0)
        across = (((same & rising) + rising) ^ rising) | same | falling
        up = falling | (full & ~(across | rising))
        down = rising & across
        if up & top:
            distance += 1
        elif down & top:
            distance -= 1
        up = ((up << 1) | 1) & full
        down = (down << 1) & full
        rising = down | (full & ~((same | falling) | up))
        falling = up & (same | falling)
    return distance


def stepwise_edits(a: str, b: str, most: int) -> int:
    """An upper bound of the edit distance: walk along what is equal, and at a difference go on where
    the next eight characters of ``a`` stand in ``b`` not far ahead. Mostly enough to accept a pair."""
    i = j = edits = 0
    while i < len(a) and j < len(b) and edits <= most:
        step = _shared(a[i:], b[j:])
        i, j = i + step, j + step
        for skip in range(0, 33, 4):
            probe = a[i + skip : i + skip + 8]
            at = b.find(probe, j, j + skip + 48) if len(probe) == 8 else -1
            if at >= 0:
                edits += max(skip, at - j)
                i, j = i + skip, at
                break
        else:
            break
    return edits + max(len(a) - i, len(b) - j)


def similar(a: str, b: str, least: float = SIMILARITY) -> bool:
    longer = max(len(a), len(b))
    if min(len(a), len(b)) < least * longer:
        return False
    most = int((1 - least) * longer + 1e-9)
    return stepwise_edits(a, b, most) <= most or edit_distance(a, b, most) <= most


def letter_counts(lines: list[str]) -> np.ndarray:
    """How often each of 64 classes of characters stands in each line; one edit moves two counts at most."""
    counts = np.zeros((len(lines), 64), dtype=np.int32)
    for i, line in enumerate(lines):
        codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        counts[i] = np.bincount(codes & 63, minlength=64)
    return counts


def _filter_of(wanted: DataFrame) -> np.ndarray:
    """A bit per slot that a wanted form hashes to: at most 2^19 words come to the driver."""
    slot = F.shiftrightunsigned("form", 64 - FILTER_BITS)
    words = wanted.groupBy(F.shiftright(slot, 6).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(shiftrightunsigned(form, {64 - FILTER_BITS}), 64) as int))")).alias("bits")
    )
    rows = words.toArrow()
    bitmap = np.zeros(1 << (FILTER_BITS - 6), dtype=np.uint64)
    bitmap[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return bitmap


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(form, text): the normalised text of each wanted form, read from the documents again."""
    context = docs.sparkSession.sparkContext
    bitmap = context.broadcast(_filter_of(wanted))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for batch in batches:
            for part in chunks(batch, "text", 2 << 20):
                found: dict[int, str] = {}
                for lines in linetext.read_lines(part.column("text").to_pylist(), with_prints=False):
                    slot = lines.forms >> np.uint64(64 - FILTER_BITS)
                    wanted_ = (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1)
                    codes = lines.forms.view(np.int64)
                    for i in np.flatnonzero(wanted_).tolist():
                        if int(codes[i]) not in found:
                            found[int(codes[i])] = lines.text(i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.string())], names=["form", "text"]
                )

    texts = docs.select("text").mapInArrow(read, "form bigint, text string")
    return texts.join(wanted, "form", "left_semi").groupBy("form").agg(F.min("text").alias("text"))


def _met_before(one: np.uint64, others: np.ndarray, block: int) -> np.ndarray:
    """Whether a pair in the bucket of ``block`` agrees in an earlier block, whose bucket compares it too.

    Fingerprints are turned so that ``block`` leads; the earlier ones follow from the end.
    """
    met = np.zeros(len(others), dtype=bool)
    for back in range(1, block + 1):
        mask = np.uint64(((1 << BLOCK_BITS) - 1) << ((back - 1) * BLOCK_BITS))
        met |= ((one ^ others) & mask) == 0
    return met


def _links(candidates: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): a spanning forest, per bucket, of the links that edit similarity confirms."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, "group"):
            forms = table["form"].to_numpy()
            prints = table["turned"].to_numpy().view(np.uint64)
            lines = table["text"]
            left, right = [], []
            buckets = table["bucket"].to_numpy()
            starts, sizes = runs(table["group"].to_numpy())
            for start, size in zip(starts.tolist(), sizes.tolist()):
                held = lines.slice(start, size).to_pylist()

                keys, block = prints[start : start + size], int(buckets[start]) >> BLOCK_BITS
                counts, sizes_ = letter_counts(held), np.array([len(line) for line in held])

                def verify(i: int, others: np.ndarray, held=held, keys=keys, block=block, counts=counts, sizes_=sizes_) -> np.ndarray:
                    # At least half of the counts that differ is edits, so many pairs are told apart by them.
                    edits = np.abs(counts[i] - counts[others]).sum(axis=1) / 2
                    fresh = edits <= (1 - SIMILARITY) * np.maximum(sizes_[i], sizes_[others]) + 1e-9
                    fresh &= ~_met_before(keys[i], keys[others], block)
                    return np.array([new and similar(held[i], held[j]) for new, j in zip(fresh.tolist(), others.tolist())], dtype=bool)

                a, b = spanning_links(keys, REACH, verify)
                left += [start + i for i in a]
                right += [start + i for i in b]
            yield pa.RecordBatch.from_arrays([pa.array(forms[left], pa.int64()), pa.array(forms[right], pa.int64())], names=["a", "b"])

    tasks = shuffle_partitions(candidates.sparkSession)
    grouped = spread_groups(candidates, "bucket", "form").join(texts, "form")
    grouped = grouped.repartition(tasks, "group").sortWithinPartitions("group", "turned")
    return grouped.select("group", "bucket", "turned", "form", "text").mapInArrow(search, "a bigint, b bigint").distinct()


def removals(docs: DataFrame) -> DataFrame:
    """(doc_id, row_hash, line_no) of every line that goes."""
    lines = staged(read_lines(docs), "lines")
    place = F.struct("doc_id", "row_hash", "line_no")
    forms = lines.groupBy("form").agg(F.first("print").alias("print"), F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    forms = staged(forms, "forms")
    candidates = staged(_candidates(forms), "close-lines")
    wanted = candidates.select("form").distinct()
    roots = components(_links(candidates, _texts_of(docs, wanted)), "lines")
    grouped = forms.join(roots, F.col("form") == F.col("node"), "left")
    root = F.coalesce("root", "form")
    # Forms that occur once and are linked with none need no second look.
    grouped = grouped.where("n > 1 or root is not null").select("form", root.alias("root"), "first")
    grouped = staged(grouped, "line-groups")
    kept = grouped.groupBy("root").agg(F.min("first").alias("kept"), F.count(F.lit(1)).alias("forms"))
    # Groups of so many forms are at most MOST_LARGE, whatever the input; they are broadcast, so no task gets one whole.
    least = max(LARGE_GROUP, -(-grouped.count() // MOST_LARGE))
    large = F.broadcast(kept.where(F.col("forms") >= least).select("root", "kept"))
    small = grouped.join(large.select("root"), "root", "left_anti").join(kept.where(F.col("forms") < least), "root")
    decided = grouped.join(large, "root").select("form", "kept").unionByName(small.select("form", "kept"))
    return lines.join(decided, "form").where(~place.eqNullSafe(F.col("kept"))).select("doc_id", "row_hash", "line_no")


def drop_lines(docs: DataFrame, removed: str = "_lines_removed") -> DataFrame:
    """``docs`` without the repeated lines, and how many were removed."""
    lines, gone_id, gone_hash, row_hash = fresh(docs, "_gone", "_gone_id", "_gone_hash", "_row_hash")
    gone = removals(docs).groupBy("doc_id", "row_hash").agg(F.array_sort(F.collect_set("line_no")).alias(lines))
    marked = docs.withColumn(row_hash, F.xxhash64("text"))
    joined = marked.join(
        gone.select(F.col("doc_id").alias(gone_id), F.col("row_hash").alias(gone_hash), lines),
        F.col("doc_id").cast("bigint").eqNullSafe(F.col(gone_id)) & (F.col(row_hash) == F.col(gone_hash)),
        "left",
    )
    cut = joined.withColumn("text", F.when(F.col(lines).isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col(lines))))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cut = cut.withColumn("n_chars", F.when(F.col(lines).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return cut.select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce(F.size(lines), F.lit(0)).alias(removed))


def _without(text: Column, gone: Column) -> Column:
    """The text's lines but those numbered in ``gone``, by built-in functions in linear time."""
    lines = F.split(text, "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = source(spark, sf_dir, "documents")
    return drop_lines(docs).select("doc_id", "text", F.col("_lines_removed").alias("lines_removed"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    (removed,) = fresh(docs, "_lines_removed")
    return drop_lines(docs, removed).drop(removed)
