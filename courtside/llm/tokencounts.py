"""Token counts as a rollup that signed deltas maintain.

A ledger keeps one signed row per count: +1 when a document's count comes in, -1 when it is taken
back, and 0 for a deletion, which is remembered. A batch of changes is settled against the ledger: an insert
adds a row, a delete takes the current one back, a revision does both. Every commit stores its signed rows, and next to
them their sums by source, language and tokenizer version; the totals are the sum over the commits, so they never
need a second look at the documents. A batch has a name: committing it again changes nothing.

Folders under the table's root: ``ledger/<name>``, ``sums/<name>`` and ``commits/<number>``, a small
file that only one writer can create and that names batch and folders. A writer that finds its number taken settles
its batch again, against what the other has committed. Rows without that file are not part of the table. ``compact``
publishes the state as one commit, from which reading then begins.

Defined cases: a null text counts 0 tokens; a null source or language is a value of its own; documents without an id are
told apart by source, language and text (``key``), equal ones being one document;
several changes of one document in a batch: the last by ``seq`` holds, ties by the largest count; a change whose
``seq`` is below that of the last one committed for its document is ignored, an equal one counts as later; a delete of an
unknown document changes no total; an insert of a known one is a revision; repeated rows of
one id in a batch are one document; an empty batch commits nothing but its name; other columns are not read.
"""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from courtside.llm.shared import source
from courtside.workspace import create_once, names_in, read_small, scratch_path, staged

TOKENIZERS = "/opt/tokenizers"
VERSION = "byte_bpe_50k"
KEYS = ("source", "lang", "tokenizer")
_LEDGER = (
    "doc_id bigint, key bigint, source string, lang string, tokenizer string, docs bigint, tokens bigint, seq bigint, number bigint"
)
_SUMS = "source string, lang string, tokenizer string, docs bigint, tokens bigint"


def _encoder(folder: str, version: str):
    import tiktoken

    with open(f"{folder}/{version}.tiktoken", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(version, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


# Fixed value: how the byte-level vocabulary expects a text to be cut before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Longest stretch given to the tokenizer at once; texts are cut before a space that follows a letter.
STRETCH = 1 << 16


def stretches(text: str) -> list[str]:
    """Parts of a long text, cut where the tokenizer cuts as well: before a space between two letters."""
    parts, at = [], 0
    while len(text) - at > STRETCH:
        cut = at + STRETCH
        while cut > at + 1 and not (text[cut] == " " and text[cut - 1].isalpha() and text[cut + 1 : cut + 2].isalpha()):
            cut -= 1
        if cut <= at + 1:
            cut = len(text)
        parts.append(text[at:cut])
        at = cut
    return [*parts, text[at:]]


def token_count(text: Column | str, version: str = VERSION, folder: str = TOKENIZERS) -> Column:
    """Number of tokens of each text; 0 for null."""

    @F.arrow_udf("bigint")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(folder, version)
        for texts in batches:
            held = (text.as_py() or "" for text in texts)
            yield pa.array([sum(len(encoder.encode_ordinary(part)) for part in stretches(t)) for t in held], pa.int64())

    return count(text)


class TokenRollup:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def commits(self) -> list[dict]:
        """The published commits in their order: batch, name of the folders, and whether it holds the whole state."""
        numbers = sorted(names_in(self.spark, f"{self.root}/commits"))
        return [json.loads(read_small(self.spark, f"{self.root}/commits/{number}")) for number in numbers]

    def _read(self, kind: str, schema: str, commits: list[dict]) -> DataFrame:
        whole = [i for i, commit in enumerate(commits) if commit["whole"]]
        paths = [f"{self.root}/{kind}/{commit['name']}" for commit in commits[whole[-1] if whole else 0 :]]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def _state(self, commits: list[dict]) -> DataFrame:
        """The last change of every document: its count, or docs 0 for one that was deleted."""
        put = self._read("ledger", _LEDGER, commits).where("docs >= 0")
        last = F.max_by(F.struct("source", "lang", "docs", "tokens", "seq"), F.struct("seq", "number")).alias("last")
        return put.groupBy("doc_id", "key", "tokenizer").agg(last).select("doc_id", "key", "tokenizer", "last.*")

    def ledger(self) -> DataFrame:
        """The current count of every document."""
        return self._state(self.commits()).where("docs > 0").select("doc_id", "key", *KEYS, "docs", "tokens")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens), added up over the commits' sums."""
        return self._totals(self.commits())

    def _totals(self, commits: list[dict]) -> DataFrame:
        sums = self._read("sums", _SUMS, commits)
        added = sums.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return added.where("docs <> 0")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Settle ``changes`` (doc_id, source, lang, tokenizer, tokens, deleted, seq, and key if there is one); False if
        the batch is known."""
        if "key" not in changes.columns:
            changes = changes.withColumn("key", F.lit(None).cast("bigint"))
        latest = Window.partitionBy("doc_id", "key", "tokenizer").orderBy(
            F.desc("seq"), F.desc("tokens"), "deleted", "source", "lang"
        )
        news = changes.withColumn("_n", F.row_number().over(latest)).where("_n = 1")
        news = news.select(
            F.col("doc_id").cast("bigint").alias("n_id"), F.col("key").alias("n_key"), F.col("source").alias("n_source"),
            F.col("lang").alias("n_lang"), F.col("tokenizer").alias("n_tokenizer"), F.col("tokens").alias("n_tokens"),
            F.col("deleted").alias("n_deleted"), F.col("seq").cast("bigint").alias("n_seq"),
        )
        while True:
            commits = self.commits()
            if any(commit["batch"] == batch for commit in commits):
                return False
            name, number = uuid.uuid4().hex, len(commits)
            signed = self._settled(news, commits).withColumn("number", F.lit(number).cast("bigint"))
            signed.write.parquet(f"{self.root}/ledger/{name}")
            written = self.spark.read.schema(_LEDGER).parquet(f"{self.root}/ledger/{name}")
            sums = written.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
            sums.write.parquet(f"{self.root}/sums/{name}")
            if self._publish(number, batch, name, False):
                return True

    def _settled(self, news: DataFrame, commits: list[dict]) -> DataFrame:
        """The signed rows by which a batch changes the state."""
        same = F.lit(True)
        for ours, theirs in (("n_id", "doc_id"), ("n_key", "key"), ("n_tokenizer", "tokenizer")):
            same = same & F.col(ours).eqNullSafe(F.col(theirs))
        joined = news.join(self._state(commits), same, "left").where(F.col("seq").isNull() | (F.col("n_seq") >= F.col("seq")))
        back = F.when(
            F.col("docs") > 0,
            F.struct("doc_id", "key", *KEYS, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens"), "seq"),
        )
        gone = F.col("n_deleted")
        put = F.struct(
            F.col("n_id").alias("doc_id"), F.col("n_key").alias("key"), F.col("n_source").alias("source"),
            F.col("n_lang").alias("lang"), F.col("n_tokenizer").alias("tokenizer"),
            F.when(gone, 0).otherwise(1).cast("bigint").alias("docs"), F.when(gone, 0).otherwise(F.col("n_tokens")).alias("tokens"),
            F.col("n_seq").alias("seq"),
        )
        return joined.select(F.explode(F.array_compact(F.array(back, put))).alias("r")).select("r.*")

    def compact(self) -> None:
        """Publish the state as one commit; earlier ones are no longer read, but their batches stay known."""
        while True:
            commits = self.commits()
            name, number = uuid.uuid4().hex, len(commits)
            state = self._state(commits).withColumn("number", F.lit(number).cast("bigint"))
            state.select(*[field.split()[0] for field in _LEDGER.split(", ")]).write.parquet(f"{self.root}/ledger/{name}")
            self._totals(commits).write.parquet(f"{self.root}/sums/{name}")
            if self._publish(number, None, name, True):
                return

    def _publish(self, number: int, batch: str | None, name: str, whole: bool) -> bool:
        """Create the commit's file; False if another writer has taken its number."""
        commit = json.dumps({"batch": batch, "name": name, "whole": whole})
        return create_once(self.spark, f"{self.root}/commits/{number:09d}", commit)


def changes_of(docs: DataFrame, deleted: bool = False, seq: int = 0, version: str = VERSION) -> DataFrame:
    """Change rows for ``docs``: their counts, or their deletion. ``key``, if it is a column, names documents without an id."""
    tokens = F.lit(0).cast("bigint") if deleted else token_count("text", version)
    key = F.col("key") if "key" in docs.columns else own_key()
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), key.alias("key"), "source", "lang", F.lit(version).alias("tokenizer"),
        tokens.alias("tokens"), F.lit(deleted).alias("deleted"), F.lit(seq).alias("seq"),
    )


def own_key() -> Column:
    """What tells documents without an id apart; null for those with one."""
    return F.when(F.col("doc_id").isNull(), F.xxhash64("source", "lang", "text"))


def trimmed_lines(text: Column) -> Column:
    """The text without lines that repeat an earlier line of it."""
    return F.array_join(F.array_distinct(F.split(text, "\n", -1)), "\n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three commits over all documents, the second one sent twice: every document comes in; those
    that repeat a line of their own are revised without it; of documents with one and the same text
    all but the first are deleted. The result is the table of totals."""
    docs = source(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang").withColumn("key", own_key())
    table = TokenRollup(spark, scratch_path(spark, "token-rollup"))
    table.commit("arrival", changes_of(docs))
    shorter = docs.withColumn("size", F.octet_length("text")).withColumn("text", trimmed_lines(F.col("text")))
    revised = staged(changes_of(shorter.where(F.octet_length("text") < F.col("size")), seq=1), "revised")
    for _ in range(2):
        table.commit("repeated lines", revised)
    # Documents of one text are told by two hashes of it and its size.
    text_is = [F.xxhash64("text").alias("h"), F.crc32("text").alias("c"), F.octet_length("text").alias("size")]
    texts = docs.select("doc_id", "source", "lang", "key", *text_is)
    first = texts.groupBy("h", "c", "size").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = texts.join(first, ["h", "c", "size"]).where("doc_id > first")
    table.commit("copies", changes_of(copies, deleted=True, seq=2))
    return table.totals()
