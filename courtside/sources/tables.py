"""Readers for stored tables. Every reader hides soft-deleted rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession, functions as F, types as T

from courtside.schemas import AUDIT_COLUMNS, CREDENTIALS, TableSpec


def visible(rows: DataFrame, marker: str = "deleted_at") -> DataFrame:
    """Soft-delete rule: only rows whose marker is unset are readable."""
    return rows.filter(F.col(marker).isNull()) if marker in rows.columns else rows


def read_parquet(spark: SparkSession, path: str, spec: TableSpec) -> DataFrame:
    rows = spark.read.schema(spec.schema).parquet(path)
    return visible(rows.select(*spec.schema.names))


def with_blooms(writer: DataFrameWriter, columns: Sequence[str], distinct: int = 1 << 20) -> DataFrameWriter:
    """Bloom filters on text columns that are looked up by equality, sized for so many values in a row group at most.

    A scan for a value no row group holds then reads the filters and no rows, also where ranges overlap.
    """
    for column in columns:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer = writer.option(f"parquet.bloom.filter.expected.ndv#{column}", str(distinct))
    return writer.option("parquet.bloom.filter.adaptive.enabled", "true")


def write_parquet(rows: DataFrame, spec: TableSpec, path: str, lookups: Sequence[str] = (), dealt: bool = False) -> None:
    """Store a table partitioned by its prune columns, sorted by key inside each file.

    ``lookups``: columns that get a bloom filter. ``dealt``: the rows already lie in ranges of the prune columns and
    the key, so they are written where they are.

    The sort gives narrow min/max ranges per row group, so a player filter skips most of
    a file. Rebalancing lets Spark split an oversized partition over several writers.
    """
    rows = rows.select(*spec.schema.names)
    if not dealt:
        rows = rows.hint("rebalance", *[F.col(c) for c in spec.partition_by])
    writer = (
        rows.sortWithinPartitions(*spec.partition_by, *[k for k in spec.keys if k not in spec.partition_by])
        .write.partitionBy(*spec.partition_by)
    )
    (with_blooms(writer, lookups) if lookups else writer).parquet(path)


def read_jdbc(spark: SparkSession, url: str, spec: TableSpec, seasons: list[int], **options) -> DataFrame:
    """The same table over JDBC, one partition per season so that reads run in parallel.

    ``seasons`` only shapes the partitions: a last one takes every other season.
    """
    listed = ", ".join(str(int(season)) for season in seasons)
    predicates = [f"season = {int(season)}" for season in seasons]
    predicates.append(f"season NOT IN ({listed})" if listed else "1 = 1")
    rows = spark.read.jdbc(url, spec.name, predicates=predicates, properties=options)
    wanted = spec.names + [column for column, _ in AUDIT_COLUMNS]
    return visible(rows.select(*[F.col(c).cast(spec.schema[c].dataType) for c in wanted]))


def read_credentials(spark: SparkSession, path: str) -> DataFrame:
    return visible(spark.read.schema(CREDENTIALS).parquet(path), "revoked_at")


def listed_credentials(credentials: DataFrame) -> DataFrame:
    """Credential listing with the hash as base64 text, as a JSON response carries it."""
    return visible(credentials, "revoked_at").withColumn("hash", F.base64("hash"))


def empty_table(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def create_tables(spark: SparkSession, root: str, specs: list[TableSpec]) -> None:
    """Materialise the empty tables (and the credential table) below ``root``."""
    for spec in specs:
        writer = empty_table(spark, spec.schema).write.mode("ignore")
        writer.parquet(f"{root}/{spec.name}")
    empty_table(spark, CREDENTIALS).write.mode("ignore").parquet(f"{root}/api_keys")
