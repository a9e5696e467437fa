"""A stored table with keyed upserts on plain Parquet.

Files are never changed in place. A commit writes the partitions it touches into a new
folder, then a small list saying which folder holds each partition, and is published last by
creating one numbered marker file, which only one writer can do. A writer that comes second
merges again on top of the other's commit. Untouched partitions are not read or rewritten.
"""

from __future__ import annotations

import json
import time
import uuid
from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from courtside.operators.merge import merge_ranges, unique_batch, with_audit
from courtside.operators.statquery import StatQuery
from courtside.schemas import TableSpec
from courtside.sources.tables import empty_table, visible
from courtside.workspace import create_once, hadoop_path, names_in, read_small, session_setting

BUCKET = "key_bucket"
# A marker is a few bytes written at once; one still unreadable after this long has lost its writer.
MARKER_WAIT_S = 10.0
ATTEMPTS = 20
# What a task reads of a batch: a few hundred thousand wide rows, which it sorts or deals out in memory.
READ_BYTES = 16 << 20
# A batch that comes in order is written where it lies if its files hold so many rows on average.
ROWS_PER_FILE = 20_000
_READ = "spark.sql.files.maxPartitionBytes"


class IncompleteCommitError(RuntimeError):
    """A published commit cannot be read whole."""


class KeyedTable:
    def __init__(self, spark: SparkSession, root: str, spec: TableSpec):
        self.spark, self.root, self.spec = spark, root.rstrip("/"), spec
        self.parts = [*spec.partition_by, BUCKET]
        types = {**spec.types, BUCKET: T.IntegerType()}
        self._stored = T.StructType(
            [f for f in spec.schema.fields if f.name not in self.parts]
            + [T.StructField(name, types[name]) for name in self.parts]
        )
        self._listing = T.StructType(
            [T.StructField(name, types[name]) for name in self.parts]
            + [T.StructField("data_commit", T.LongType()), T.StructField("folder", T.StringType())]
        )

    def _bucket(self, key: Column | None = None) -> Column:
        """Rows of one leading key share a bucket, so a small batch reaches few buckets."""
        hashed = F.xxhash64(F.col(self.spec.keys[0]) if key is None else key)
        return F.pmod(hashed, F.lit(self.spec.buckets)).cast("int")

    def version(self) -> int:
        """Number of the newest published commit, 0 for a table that was never written."""
        return max((int(name) for name in names_in(self.spark, f"{self.root}/commits") if name.isdigit()), default=0)

    def _marker(self, version: int) -> dict:
        """What a commit's marker says: its list's folder and size, and the last batch of each stream."""
        if version == 0:
            return {"streams": {}}
        deadline = time.monotonic() + MARKER_WAIT_S
        while True:
            try:
                return json.loads(read_small(self.spark, f"{self.root}/commits/{version:012d}"))
            except json.JSONDecodeError:
                if time.monotonic() > deadline:
                    raise IncompleteCommitError(f"{self.root}: marker of commit {version} is not complete") from None
                time.sleep(0.2)

    def partitions(self, version: int | None = None) -> DataFrame:
        """Partition -> commit and folder. One row per partition, so always small."""
        version = self.version() if version is None else version
        if version == 0:
            return empty_table(self.spark, self._listing)
        return self.spark.read.schema(self._listing).parquet(f"{self.root}/partitions/{self._marker(version)['list']}")

    def _places(self, version: int) -> list:
        found = self.partitions(version).collect()
        if version and len(found) != self._marker(version)["partitions"]:
            raise IncompleteCommitError(f"{self.root}: the list of commit {version} is not complete")
        return found

    def read_all(self, version: int | None = None, query: StatQuery | None = None) -> DataFrame:
        """Every stored row, soft-deleted ones included; with ``query``, of the partitions it can touch."""
        version = self.version() if version is None else version
        return self._scan([row for row in self._places(version) if query is None or self._reached(row, query)])

    def read(self, version: int | None = None, query: StatQuery | None = None) -> DataFrame:
        return visible(self.read_all(version, query))

    def _reached(self, row, query: StatQuery) -> bool:
        """Whether a partition can hold rows of ``query``, by season, phase and the player's bucket."""
        for name in self.spec.partition_by:
            wanted = getattr(query, name, None)
            if wanted is not None and row[name] != wanted:
                return False
        leading = self.spec.keys[0]
        wanted = getattr(query, leading, None)
        return wanted is None or row[BUCKET] == self._bucket_of(wanted)

    def _bucket_of(self, value) -> int:
        one = self.spark.range(1).select(self._bucket(F.lit(value).cast(self.spec.types[self.spec.keys[0]])))
        return one.first()[0]

    def _folder(self, row) -> str:
        def text(value):
            return str(value).lower() if isinstance(value, bool) else str(value)

        inner = "/".join(f"{name}={text(row[name])}" for name in self.parts)
        return f"{self.root}/data/commit={row['folder']}/{inner}"

    def _scan(self, listing) -> DataFrame:
        if not listing:
            return empty_table(self.spark, self.spec.schema)
        reader = self.spark.read.schema(self._stored).option("basePath", f"{self.root}/data")
        rows = reader.parquet(*[self._folder(row) for row in listing])
        return rows.select(*self.spec.schema.names)

    def upsert(
        self,
        batch: DataFrame,
        stamp: datetime,
        on_duplicate: str = "error",
        order: list[str] | None = None,
        commit: int | None = None,
        stream: str = "",
    ) -> int:
        """Merge ``batch`` and publish; returns the commit number. An empty batch writes nothing.

        ``commit`` is the batch's number within ``stream``. It makes a replay harmless: a batch
        is skipped if its stream has published that number or a later one. It is apart from
        the table's own commit number, so several streams and single batches can share a table.
        """
        if commit is not None:
            current = self.version()
            if self._marker(current)["streams"].get(stream, commit - 1) >= commit:
                return current
        name = uuid.uuid4().hex
        stage = f"{self.root}/staging/{name}"
        fresh = with_audit(batch.select(*self.spec.names, *self._extra(batch, order)), stamp)
        fresh = fresh.withColumn(BUCKET, self._bucket())
        fresh.write.option("parquet.block.size", READ_BYTES).parquet(stage)
        fresh = self.spark.read.schema(fresh.schema).parquet(stage)
        try:
            with session_setting(self.spark, _READ, str(READ_BYTES)):
                touched = self._spread(fresh)
                if not touched:
                    return self.version()
                # Checked on the staged rows, so the error leaves the table as it was.
                fresh = unique_batch(fresh, self.spec, on_duplicate, order, sum(rows for rows, _ in touched.values()))
                if on_duplicate != "error":  # shuffled by key, so in no order
                    touched = {part: (rows, rows) for part, (rows, _) in touched.items()}
                for attempt in range(ATTEMPTS):
                    number = self._attempt(fresh, touched, f"{name}-{attempt}", commit, stream)
                    if number is not None:
                        return number
            raise RuntimeError(f"{self.root}: other writers were first {ATTEMPTS} times")
        finally:
            self._delete(stage)

    def _spread(self, fresh: DataFrame) -> dict[tuple, tuple[int, int]]:
        """Partition -> rows of the batch, and files they make if each task writes what it reads."""
        files = fresh.groupBy(*self.parts, F.spark_partition_id().alias("_task")).agg(F.count(F.lit(1)).alias("_rows"))
        found = files.groupBy(*self.parts).agg(F.sum("_rows"), F.count(F.lit(1))).collect()
        return {tuple(row)[:-2]: tuple(row)[-2:] for row in found}

    def _among(self, rows: DataFrame, places: list[tuple], how: str) -> DataFrame:
        """The rows in ("left_semi") or outside ("left_anti") the partitions."""
        kinds = T.StructType([field for field in self._listing.fields if field.name in self.parts])
        named = F.broadcast(self.spark.createDataFrame(places, kinds))
        return rows.join(named, reduce(and_, [rows[c].eqNullSafe(named[c]) for c in self.parts]), how)

    def _attempt(self, fresh: DataFrame, touched: dict, name: str, commit: int | None, stream: str) -> int | None:
        """Merge on top of the newest commit; None if another writer published meanwhile."""
        current = self.version()
        streams = dict(self._marker(current)["streams"])
        if commit is not None:
            if streams.get(stream, commit - 1) >= commit:
                return current
            streams[stream] = commit
        held = self._places(current)
        key = lambda row: tuple(row[part] for part in self.parts)
        met = [row for row in held if key(row) in touched]
        order = [*self.parts, *[k for k in self.spec.keys if k not in self.parts]]
        columns = [*self.spec.schema.names, BUCKET]
        batch, total = fresh.select(*columns), sum(rows for rows, _ in touched.values())
        target = self._scan(met).withColumn(BUCKET, self._bucket()).select(*columns) if met else None
        stored = target.count() if met else 0
        known = [key(row) for row in met]
        new = [touched[part] for part in touched.keys() - set(known)]
        written = []
        # New partitions have nothing to merge with, so rows that come in order need no shuffle.
        if new and sum(rows for rows, _ in new) >= ROWS_PER_FILE * sum(files for _, files in new):
            alone = self._among(batch, known, "left_anti") if met else batch
            written.append(alone.sortWithinPartitions(*order))
            batch, total = self._among(batch, known, "left_semi") if met else None, sum(touched[part][0] for part in known)
        if batch is not None:
            written.append(merge_ranges(target, batch, self.spec, order, total + stored))
        for rows in written:  # sorted by partition and key
            rows.write.mode("append").partitionBy(*self.parts).parquet(f"{self.root}/data/commit={name}")
        kept = [tuple(row) for row in held if key(row) not in touched]
        listing = kept + [(*parts, current + 1, name) for parts in sorted(touched, key=repr)]
        frame = self.spark.createDataFrame(listing, self._listing)
        frame.coalesce(1).write.parquet(f"{self.root}/partitions/{name}")
        marker = {"list": name, "partitions": len(listing), "streams": streams}
        if create_once(self.spark, f"{self.root}/commits/{current + 1:012d}", json.dumps(marker)):
            return current + 1
        self._delete(f"{self.root}/data/commit={name}")
        self._delete(f"{self.root}/partitions/{name}")
        return None

    def _delete(self, path: str) -> None:
        files, folder = hadoop_path(self.spark, path)
        files.delete(folder, True)

    def vacuum(self, keep: int = 10) -> int:
        """Drop all but the newest ``keep`` commits and the folders only they use; returns how many went.

        Not to be run while an upsert is under way, nor while older versions are read.
        """
        numbers = sorted(int(name) for name in names_in(self.spark, f"{self.root}/commits") if name.isdigit())
        gone, kept = numbers[:-keep], numbers[-keep:]
        lists = {self._marker(number)["list"] for number in kept}
        folders = {row["folder"] for number in kept for row in self._places(number)}
        for number in gone:
            self._delete(f"{self.root}/commits/{number:012d}")
        for kind, used in (("partitions", lists), ("data", {f"commit={folder}" for folder in folders})):
            for name in names_in(self.spark, f"{self.root}/{kind}"):
                if name not in used:
                    self._delete(f"{self.root}/{kind}/{name}")
        return len(gone)

    def _extra(self, batch: DataFrame, order: list[str] | None) -> list[str]:
        return [c for c in (order or []) if c in batch.columns and c not in self.spec.names]
