"""Registered queries and the SQL each one is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from courtside.checks import feeds
from courtside.checks.reference_sql import statement
from courtside.schemas import ADVANCED, SHOTS, TOTALS, TableSpec
from courtside.sources.tables import read_parquet, write_parquet
from courtside.workspace import scratch_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
_stored: dict[tuple[str, str, str], str] = {}


def query(name: str, sql: str | None = None):
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query name: {name}")
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = statement(sql)
        return function

    return register


def _derive(spark: SparkSession, sf_dir: str, spec: TableSpec) -> DataFrame:
    if spec is SHOTS:
        return feeds.shots(feeds.source(spark, sf_dir, "events"))
    return {TOTALS.name: feeds.totals, ADVANCED.name: feeds.advanced}[spec.name](spark, sf_dir)


def stored_path(spark: SparkSession, sf_dir: str, spec: TableSpec) -> str:
    """Where the derived table is stored; written on first use in a session."""
    key = (spark.sparkContext.applicationId, sf_dir, spec.name)
    if key not in _stored:
        path = scratch_path(spark, spec.name)
        # The season tables come in ranges of season, phase and player.
        write_parquet(_derive(spark, sf_dir, spec), spec, path, dealt=spec is not SHOTS)
        _stored[key] = path
    return _stored[key]


def table(spark: SparkSession, sf_dir: str, spec: TableSpec) -> DataFrame:
    return read_parquet(spark, stored_path(spark, sf_dir, spec), spec)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.source(spark, sf_dir, "events")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.source(spark, sf_dir, "customer")


def columns(spec: TableSpec, prefix: str = "", quoted: bool = True) -> str:
    return ", ".join(f'{prefix}"{c}"' if quoted else f"{prefix}{c}" for c in spec.names)


def response_columns(spec: TableSpec) -> str:
    return ", ".join(f'"{c}" AS "{r}"' for c, r in spec.response_names.items())
