"""Benchmark decontamination with a positional inverted index of the training documents.

The index is stored as Parquet in the shared folder, one row per segment of some MB of text:
the segment's terms (64-bit hashes, sorted), for each its postings (word positions, documents laid end
to end with a gap between them), and the documents' places. Terms and postings are plain bytes, and a
row group holds a few segments only: readers decode whole row groups at once, and lists with their
levels took several times their size there. A test window is looked up segment
by segment: windows with a term the segment lacks go at once; the others start from the
postings of their rarest term there, shifted by the term's place in the window, and are
intersected with the shifted postings of the next rarer terms until none or whole phrases are left.

Test items are taken in blocks of bounded size, each block broadcast and held against all
segments; so the benchmark may be of any size, and only the number of blocks grows.

Defined cases: null or empty texts have no words and hit nothing; an item without words or without
an id is no item; items of one id are one item; repeated documents each get their row; without
items or documents the result has no hits or no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from courtside.llm.shared import chunks, fresh, source
from courtside.workspace import scratch_path, session_setting, staged

WINDOW = 13
# Text per index segment and test text per block, in bytes.
SEGMENT_BYTES = 2 << 20
BLOCK_BYTES = 8 << 20
# Index rows that are written and read at a time, in bytes as stored; one segment at least.
ROW_GROUP_BYTES = 8 << 20
# Rows that go to a Python worker at a time; the executor holds such a batch several times over.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20

# On lower-cased UTF-8 bytes: every character but ASCII ones that are no letter or digit.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

_INDEX_FIELDS = [
    ("segment", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("row_hashes", pa.list_(pa.int64())),
    ("starts", pa.list_(pa.int32())), ("n_words", pa.list_(pa.int32())),
    ("terms", pa.binary()), ("ends", pa.binary()), ("positions", pa.binary()),
]
_INDEX = pa.schema(_INDEX_FIELDS)
_INDEX_DDL = (
    "segment bigint, doc_ids array<bigint>, row_hashes array<bigint>, starts array<int>, n_words array<int>, "
    "terms binary, ends binary, positions binary"
)
_PLAIN = {"terms": np.dtype("<i8"), "ends": np.dtype("<i4"), "positions": np.dtype("<i4")}


def words_of(text: bytes | None) -> list[bytes]:
    return _WORD.findall(text.lower()) if text else []


def term_hash(word: bytes) -> int:
    code = xxhash.xxh64_intdigest(word)
    return code - (1 << 64) if code >> 63 else code


def _segment(number: int, part: pa.RecordBatch) -> pa.RecordBatch:
    """The index row of one slice of documents."""
    codes: dict[bytes, int] = {}
    put = codes.setdefault
    ids: list[np.ndarray] = []
    counts, starts, at = [], [], 0
    for text in part.column("text").cast(pa.binary()).to_pylist():
        words = words_of(text)
        ids.append(np.fromiter((put(w, len(codes)) for w in words), dtype=np.int32, count=len(words)))
        counts.append(len(words))
        starts.append(at)
        at += len(words) + 1  # a gap, so that no phrase reaches into the next document
    first = np.repeat(np.array(starts, dtype=np.int32), counts)
    within = np.concatenate([np.arange(n, dtype=np.int32) for n in counts]) if counts else np.empty(0, np.int32)
    local = np.concatenate(ids) if ids else np.empty(0, np.int32)
    hashes = np.fromiter(map(term_hash, codes), dtype=np.int64, count=len(codes))
    rank = np.argsort(hashes, kind="stable")
    place = np.empty(len(rank), dtype=np.int32)
    place[rank] = np.arange(len(rank), dtype=np.int32)
    local = place[local]
    order = np.argsort(local, kind="stable")
    ends = np.cumsum(np.bincount(local, minlength=len(rank))).astype(np.int32)
    columns = [
        pa.array([number], pa.int64()),
        pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())),
        pa.array([part.column("row_hash").to_pylist()], pa.list_(pa.int64())),
        pa.array([starts], pa.list_(pa.int32())),
        pa.array([counts], pa.list_(pa.int32())),
    ]
    for name, values in (("terms", hashes[rank]), ("ends", ends), ("positions", (first + within)[order])):
        columns.append(pa.array([values.astype(_PLAIN[name]).tobytes()], pa.binary()))
    return pa.RecordBatch.from_arrays(columns, schema=_INDEX)


def build_index(docs: DataFrame, path: str) -> DataFrame:
    """Write the index of all ``docs`` to ``path`` and read it back. One narrow pass."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = 0
        for batch in batches:
            task = batch.column("task")[0].as_py() if batch.num_rows else 0
            for part in chunks(batch, "text", SEGMENT_BYTES):
                # Segment numbers repeat on a retry: the task's rows come in the same order.
                yield _segment((task << 32) | count, part)
                count += 1

    rows = docs.select(
        F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("row_hash"), "text", F.spark_partition_id().alias("task")
    )
    # Sizes are looked at after each row: a row is a segment, and the writer's own first look is at the 100th.
    stored = {
        "compression": "zstd", "parquet.enable.dictionary": "false", "parquet.block.size": str(ROW_GROUP_BYTES),
        "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1",
    }
    with session_setting(docs.sparkSession, BATCH_SETTING, str(BATCH_BYTES)):
        rows.mapInArrow(build, _INDEX_DDL).write.options(**stored).parquet(path)
    return docs.sparkSession.read.parquet(path)


@dataclass
class TestBlock:
    """Distinct windows of some items, as stretches of the items' words; shorter items have shorter windows."""

    terms: np.ndarray  # sorted term hashes
    words: np.ndarray  # term numbers of all words, item after item
    starts: np.ndarray  # of each window, the place in words
    lengths: np.ndarray
    items: np.ndarray  # the items the windows come from, window after window
    ends: np.ndarray  # of each window, the place in items

    def window(self, number: int) -> np.ndarray:
        return self.words[self.starts[number] : self.starts[number] + self.lengths[number]]

    def held_by(self, number: int) -> list[int]:
        return self.items[self.ends[number - 1] if number else 0 : self.ends[number]].tolist()


def test_block(items: list[tuple[int, str]], window: int = WINDOW) -> TestBlock:
    codes: dict[bytes, int] = {}
    put = codes.setdefault
    texts = [np.empty(0, dtype=np.int32)]
    for _, text in items:
        held = words_of(text.encode()) if text else []
        texts.append(np.fromiter((put(w, len(codes)) for w in held), dtype=np.int32, count=len(held)))
    hashes = np.fromiter(map(term_hash, codes), dtype=np.int64, count=len(codes))
    terms, number = np.unique(hashes, return_inverse=True)
    words = number.astype(np.int32)[np.concatenate(texts)]
    counts = np.array([len(t) for t in texts[1:]], dtype=np.int64)
    windows = np.maximum(counts - window + 1, np.minimum(counts, 1))
    firsts = np.cumsum(counts) - counts - (np.cumsum(windows) - windows)
    starts = np.repeat(firsts, windows) + np.arange(windows.sum())
    lengths = np.repeat(np.minimum(counts, window), windows)
    holders = np.repeat(np.array([i for i, _ in items], dtype=np.int64), windows)

    # Equal windows come together by a hash of their terms, and count as one if they are equal word by word.
    marks = lengths.astype(np.uint64)
    for offset in range(window):
        inside = np.flatnonzero(lengths > offset)
        marks[inside] = marks[inside] * np.uint64(0x9E3779B97F4A7C15) + terms[words[starts[inside] + offset]].view(np.uint64)
    order = np.argsort(marks, kind="stable")
    starts, lengths, holders = starts[order], lengths[order], holders[order]
    again = np.zeros(len(order), dtype=bool)
    again[1:] = lengths[1:] == lengths[:-1]
    for offset in range(window):
        inside = np.flatnonzero(again & (lengths > offset))
        again[inside] = words[starts[inside] + offset] == words[starts[inside - 1] + offset]
    heads = np.flatnonzero(~again)
    kept = ~again
    kept[1:] |= holders[1:] != holders[:-1]
    ends = np.cumsum(kept)[np.append(heads[1:], len(order)) - 1] if len(heads) else np.empty(0, dtype=np.int64)
    return TestBlock(terms, words, starts[heads].astype(np.int32), lengths[heads].astype(np.int32), holders[kept], ends)


class _Segment:
    def __init__(self, row: dict[str, np.ndarray], terms: np.ndarray):
        held, self.ends, self.positions = row["terms"], row["ends"], row["positions"]
        at = np.searchsorted(held, terms)
        inside = at < len(held)
        known = np.zeros(len(terms), dtype=bool)
        known[inside] = held[at[inside]] == terms[inside]
        self.low = np.where(known & (at > 0), self.ends[np.maximum(at, 1) - 1] if len(held) else 0, 0)
        self.high = np.where(known, self.ends[np.minimum(at, len(held) - 1)] if len(held) else 0, 0)
        self.high = np.maximum(self.high, self.low)
        self.counts = np.where(known, self.high - self.low, 0).astype(np.int64)

    def postings(self, term: int) -> np.ndarray:
        return self.positions[self.low[term] : self.high[term]]


def _present(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    at = np.searchsorted(among, values)
    at[at == len(among)] = 0
    return among[at] == values


def _candidates(segment: _Segment, block: TestBlock) -> list[int]:
    """The windows of which the segment has all terms."""
    lacking = np.zeros(len(block.words) + 1, dtype=np.int32)
    np.cumsum(segment.counts[block.words] == 0, out=lacking[1:])
    return np.flatnonzero(lacking[block.starts + block.lengths] == lacking[block.starts]).tolist()


def phrase_starts(segment: _Segment, block: TestBlock) -> Iterator[tuple[int, np.ndarray]]:
    """(window, word positions where it starts) for the windows that occur in the segment."""
    for window in _candidates(segment, block):
        terms = block.window(window)
        starts = None
        for offset in np.argsort(segment.counts[terms], kind="stable").tolist():
            shifted = segment.postings(terms[offset]).astype(np.int64) - offset
            starts = shifted if starts is None else starts[_present(starts, shifted)]
            if not len(starts):
                break
        if len(starts):
            yield window, starts


def near_starts(segment: _Segment, block: TestBlock, span: int) -> Iterator[tuple[int, np.ndarray]]:
    """(window, first positions of stretches of at most ``span`` words that hold all its terms, in any order).

    Stretches begin at a word of the window and are the shortest from there.
    """
    for window in _candidates(segment, block):
        needed: dict[int, int] = {}
        for term in block.window(window).tolist():
            needed[term] = needed.get(term, 0) + 1
        rarest = segment.postings(min(needed, key=lambda t: segment.counts[t])).astype(np.int64)
        lists = {t: segment.postings(t).astype(np.int64) for t in needed}
        near = rarest
        for t, times in needed.items():
            low = np.searchsorted(lists[t], near - span + 1)
            high = np.searchsorted(lists[t], near + span)
            near = near[high - low >= times]
        starts = set()
        for anchor in near.tolist():
            around = sorted(
                (int(p), t)
                for t in needed
                for p in lists[t][np.searchsorted(lists[t], anchor - span + 1) : np.searchsorted(lists[t], anchor + span)]
            )
            missing, held, tail = len(needed), dict.fromkeys(needed, 0), 0
            for position, t in around:
                held[t] += 1
                missing -= held[t] == needed[t]
                while not missing:
                    first, gone = around[tail]
                    if position - first < span:
                        starts.add(first)
                    held[gone] -= 1
                    missing += held[gone] < needed[gone]
                    tail += 1
        if starts:
            yield window, np.array(sorted(starts), dtype=np.int64)


def _numpy_rows(batch: pa.RecordBatch, names: list[str]) -> Iterator[dict[str, np.ndarray]]:
    for i in range(batch.num_rows):
        held = {name: batch.column(name)[i] for name in names}
        yield {
            name: np.frombuffer(value.as_buffer(), dtype=_PLAIN[name]) if name in _PLAIN else value.values.to_numpy(zero_copy_only=False)
            for name, value in held.items()
        }


def _search(index: DataFrame, block: TestBlock, span: int | None) -> DataFrame:
    """(segment, ordinal, hit_words, items) for documents of the index with a match of the block, in the shared folder."""
    sent = index.sparkSession.sparkContext.broadcast(block)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        for batch in batches:
            numbers = batch.column("segment").to_pylist()
            for number, row in zip(numbers, _numpy_rows(batch, ["starts", "n_words", "terms", "ends", "positions"])):
                segment = _Segment(row, block.terms)
                hits: dict[int, set[int]] = {}
                items: dict[int, set[int]] = {}
                matches = phrase_starts(segment, block) if span is None else near_starts(segment, block, span)
                for window, starts in matches:
                    length = int(block.lengths[window]) if span is None else 1
                    of = np.searchsorted(row["starts"], starts, side="right") - 1
                    for document, start in zip(of.tolist(), (starts - row["starts"][of]).tolist()):
                        if span is not None and start + 1 > row["n_words"][document]:
                            continue
                        hits.setdefault(document, set()).update(range(start, start + length))
                        items.setdefault(document, set()).update(block.held_by(window))
                found = sorted(hits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * len(found), pa.int64()), pa.array(found, pa.int32()),
                     pa.array([sorted(hits[d]) for d in found], pa.list_(pa.int32())),
                     pa.array([sorted(items[d]) for d in found], pa.list_(pa.int64()))],
                    names=["segment", "ordinal", "hit_words", "items"],
                )

    ddl = "segment bigint, ordinal int, hit_words array<int>, items array<bigint>"
    found = index.select("segment", "starts", "n_words", "terms", "ends", "positions").mapInArrow(search, ddl)
    with session_setting(index.sparkSession, BATCH_SETTING, str(BATCH_BYTES)):
        hits = staged(found, "benchmark-hits")
    sent.destroy()
    return hits


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """All items, in blocks of about BLOCK_BYTES of text."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("bigint"), "text").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(-(-total // BLOCK_BYTES))
    for number in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number)
        yield [(row[0], row[1]) for row in part.orderBy("item_id", "text").collect()]


def matches(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, span: int | None = None) -> DataFrame:
    """(doc_id, row_hash, n_words, hit_words, items) for every indexed document.

    Exact phrase matches of all windows; with ``span``, proximity matches: stretches of at most
    that many words holding a window's words in any order (hit_words are then their first words).
    """
    schema = T.StructType(
        [T.StructField("segment", T.LongType()), T.StructField("ordinal", T.IntegerType()),
         T.StructField("hit_words", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.LongType()))]
    )
    found = index.sparkSession.createDataFrame([], schema)
    for items in _blocks(benchmark):
        found = found.unionByName(_search(index, test_block(items, window), span))
    merged = found.groupBy("segment", "ordinal").agg(
        F.array_distinct(F.flatten(F.collect_list("hit_words"))).alias("hit_words"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
    )
    documents = index.select(
        "segment", F.posexplode(F.arrays_zip("doc_ids", "row_hashes", "n_words")).alias("ordinal", "d")
    ).select("segment", "ordinal", "d.doc_ids", "d.row_hashes", "d.n_words")
    none = F.array().cast("array<bigint>")
    return documents.join(merged, ["segment", "ordinal"], "left").select(
        F.col("doc_ids").alias("doc_id"),
        F.col("row_hashes").alias("row_hash"),
        F.col("n_words").cast("bigint").alias("n_words"),
        F.coalesce("hit_words", F.array().cast("array<int>")).alias("hit_words"),
        F.coalesce("items", none).alias("items"),
    )


def decontamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Index ``docs`` and match every window: ``matches`` plus n_hit and contaminated."""
    index = build_index(docs, scratch_path(docs.sparkSession, "token-index"))
    found = matches(index, benchmark, window).withColumn("n_hit", F.size("hit_words").cast("bigint"))
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination(source(spark, sf_dir, "documents"), source(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"), "contaminated",
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated, told apart by their id and their text's hash."""
    bad = decontamination(docs, source(spark, sf_dir, "benchmark")).where("contaminated")
    bad_id, bad_hash = fresh(docs, "_bad_id", "_bad_hash")
    bad = bad.select(F.col("doc_id").alias(bad_id), F.col("row_hash").alias(bad_hash)).distinct()
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col(bad_id)) & (F.xxhash64("text") == F.col(bad_hash))
    return docs.join(bad, same, "left_anti")
