"""Merges into Spark's own bucketed tables.

A table is bucketed and sorted by its whole natural key, so a merge shuffles the batch alone: both sides meet by
the buckets that the target's files already lie in. Only the partitions a batch touches are read; their merged rows are written as a
staged copy first, a table with the same buckets, and then put in place by Spark's dynamic partition overwrite without
another shuffle. A task holds a bucket, so their number has to suit the rows of the table. Each partition column is a copy of a key
column, since Spark does not bucket by the columns it partitions by.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from courtside.operators.merge import merge_rows, unique_batch, with_audit
from courtside.schemas import AUDIT_COLUMNS, TableSpec
from courtside.workspace import hadoop_path, scratch_path, session_setting, staged

_DYNAMIC = "spark.sql.sources.partitionOverwriteMode"
_AUTO_SCAN = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
# Rows of a bucket, over all partitions, that a task sorts at ease; and the fewest buckets of a table.
BUCKET_ROWS, FEWEST_BUCKETS = 250_000, 8


def buckets_for(rows: int) -> int:
    """Buckets of a table that will hold about so many rows."""
    return max(FEWEST_BUCKETS, -(-rows // BUCKET_ROWS))


@dataclass
class BucketTable:
    """A table of ``spec`` in the session's catalog, its files below ``path``."""

    spark: SparkSession
    name: str
    path: str
    spec: TableSpec
    buckets: int = FEWEST_BUCKETS

    def _parts(self) -> dict[str, str]:
        """Partition columns and the key columns they copy."""
        return {f"part_{column}": column for column in self.spec.partition_by}

    def _columns(self) -> list[str]:
        return [*self.spec.names, *(column for column, _ in AUDIT_COLUMNS)]

    def _create(self, name: str, path: str) -> None:
        kinds = self.spec.types
        fields = [f"`{column}` {kinds[column].simpleString()}" for column in self.spec.names]
        fields += [f"`{column}` timestamp_ntz" for column, _ in AUDIT_COLUMNS]
        fields += [f"`{part}` {kinds[column].simpleString()}" for part, column in self._parts().items()]
        keys = ", ".join(f"`{key}`" for key in self.spec.keys)
        parts = ", ".join(f"`{part}`" for part in self._parts())
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({', '.join(fields)}) USING parquet PARTITIONED BY ({parts}) "
            f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

    def create(self) -> None:
        """The table, empty, or as it is stored at ``path``."""
        self._create(self.name, self.path)
        files, folder = hadoop_path(self.spark, self.path)
        files.mkdirs(folder)
        self.spark.sql(f"ALTER TABLE {self.name} RECOVER PARTITIONS")

    def read(self) -> DataFrame:
        return self.spark.table(self.name).select(*self._columns())

    def merged(self, batch: DataFrame) -> DataFrame:
        """The touched partitions after the batch: the plan has no shuffle of the target."""
        touched = F.lit(False)
        # One row for each partition of the batch.
        for values in batch.select(*self.spec.partition_by).distinct().collect():
            inside = F.lit(True)
            for part, value in zip(self._parts(), values):
                inside = inside & (F.col(part) == F.lit(value))
            touched = touched | inside
        target = self.spark.table(self.name).where(touched).select(*self._columns())
        # The batch is dealt out as the table's buckets are.
        dealt = batch.select(*self._columns()).repartition(self.buckets, *self.spec.keys)
        return merge_rows(target.hint("merge"), dealt, self.spec)

    def upsert(self, batch: DataFrame, stamp: datetime, on_duplicate: str = "error", order: list[str] | None = None) -> None:
        """Merge a batch by natural key. A key that a batch holds twice is an error, or the last by ``order`` counts."""
        batch = staged(with_audit(unique_batch(batch, self.spec, on_duplicate, order), stamp), f"{self.spec.name}-batch")
        copies = {part: F.col(column) for part, column in self._parts().items()}
        merged = self.merged(batch).withColumns(copies)
        ready, path = f"merged_{uuid.uuid4().hex}", scratch_path(self.spark, f"{self.spec.name}-merged")
        self._create(ready, path)
        try:
            # The merged rows lie in the table's buckets already: after one shuffle of the batch none is left to do.
            merged.write.insertInto(ready)
            with session_setting(self.spark, _DYNAMIC, "dynamic"), session_setting(self.spark, _AUTO_SCAN, "false"):
                self.spark.table(ready).write.mode("overwrite").insertInto(self.name)
        finally:
            self.spark.sql(f"DROP TABLE {ready}")
