"""Filtered totals without a scan: counts over (season, phase, team), kept by the signed deltas of each change.

The cube holds one count for every combination of the three columns and of those left open. Rows that appear
add one to each of their combinations, rows that vanish take one away, and both are added up before they
are stored, so a change costs its own size and a total reads a few small rows. Changes are named; one
that is sent again replaces itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from courtside.operators.merge import merge_actions
from courtside.operators.paging import page_meta
from courtside.operators.statquery import StatQuery
from courtside.schemas import TableSpec
from courtside.sources.tables import visible
from courtside.workspace import create_once, names_in

DIMENSIONS = ("season", "is_playoff", "team")
_SCHEMA = "season bigint, is_playoff boolean, team string, open_columns int, n bigint"
# Filters that no combination of the dimensions can answer.
_OTHER = ("player_id", "player_name", "name_contains")


def signed(rows: DataFrame, sign: int) -> DataFrame:
    return rows.select(*DIMENSIONS, F.lit(sign).cast("bigint").alias("_sign"))


def insert_deltas(target: DataFrame, batch: DataFrame, spec: TableSpec) -> DataFrame:
    """What a merge of ``batch`` changes: new keys appear. Matched keys keep their dimensions, which are
    part of the key, and their deletion mark."""
    return signed(merge_actions(target, batch, spec).where("operation = 'insert'"), 1)


def visibility_deltas(before: DataFrame, after: DataFrame, spec: TableSpec) -> DataFrame:
    """What any change of visible rows comes to, keys of both states compared."""
    gone = visible(before).join(visible(after), list(spec.keys), "left_anti")
    come = visible(after).join(visible(before), list(spec.keys), "left_anti")
    return signed(gone, -1).unionByName(signed(come, 1))


@dataclass
class CountCube:
    spark: SparkSession
    path: str

    def _changes(self) -> list[str]:
        return sorted(name.removesuffix(".done") for name in names_in(self.spark, self.path) if name.endswith(".done"))

    def cells(self) -> DataFrame:
        """Every combination with its count; ``open_columns`` has a bit for each column left open."""
        paths = [f"{self.path}/{name}" for name in self._changes()]
        if not paths:
            return self.spark.createDataFrame([], _SCHEMA)
        stored = self.spark.read.schema(_SCHEMA).parquet(*paths)
        return stored.groupBy(*DIMENSIONS, "open_columns").agg(F.sum("n").alias("n")).where("n <> 0")

    def apply(self, change: str, deltas: DataFrame) -> bool:
        """Adds the signed rows of a named change; False if it is there already, and nothing is added."""
        if change in self._changes():
            return False
        cube = deltas.cube(*DIMENSIONS).agg(F.sum("_sign").alias("n"), F.grouping_id().cast("int").alias("open_columns"))
        cube.select(*DIMENSIONS, "open_columns", "n").where("n <> 0").coalesce(1).write.mode("overwrite").parquet(
            f"{self.path}/{change}"
        )
        return create_once(self.spark, f"{self.path}/{change}.done", "")

    def covers(self, query: StatQuery) -> bool:
        return not any(getattr(query, name) for name in _OTHER)

    def total(self, query: StatQuery) -> DataFrame:
        """One row, total: the count of visible rows that the query matches."""
        if not self.covers(query):
            raise ValueError("the cube has no counts by player")
        open_columns, wanted = 0, F.lit(True)
        for place, name in enumerate(DIMENSIONS):
            value = getattr(query, name)
            if value is None:
                open_columns |= 1 << len(DIMENSIONS) - 1 - place
            else:
                wanted = wanted & (F.col(name) == F.lit(value))
        cell = self.cells().where(wanted & (F.col("open_columns") == open_columns))
        return cell.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))

    def page_meta(self, rows: DataFrame, query: StatQuery) -> DataFrame:
        """As ``paging.page_meta``; only filters by player read the rows."""
        if not self.covers(query):
            return page_meta(rows, query)
        size = F.lit(query.page_size).cast("bigint")
        return self.total(query).select(
            "total",
            F.lit(query.page).cast("bigint").alias("page"),
            size.alias("pageSize"),
            F.expr(f"(total + {query.page_size} - 1) div {query.page_size}").alias("pages"),
        )
