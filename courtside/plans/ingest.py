"""Batch ingest: tasks and pages to merged tables, with a run log."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from courtside.operators.extract import (
    extract_shots,
    extract_tables,
    shot_rows,
    table_rows,
    typed_rows,
    typed_shots,
)
from courtside.operators.keyedtable import KeyedTable
from courtside.operators.merge import last_of_duplicates, split_duplicate_batches
from courtside.schemas import SHOTS, TableSpec
from courtside.sources.pagefeeds import pages_of_tasks
from courtside.streaming.live import stream_id
from courtside.workspace import staged


@dataclass
class Ingested:
    """Result of reading a set of pages for one table."""

    rows: DataFrame
    malformed: DataFrame
    page_status: DataFrame
    rejected_pages: DataFrame


def ingest_stat_pages(pages: DataFrame, tasks: DataFrame, spec: TableSpec) -> Ingested:
    """Season pages of one table. One bad page or row never affects another page."""
    wanted = tasks.filter(F.col("table_name") == spec.name)
    # Read the markup once; rows, statuses and the run log all come from the stored result.
    extracted = staged(extract_tables(pages_of_tasks(pages, wanted), spec), spec.name)
    body = table_rows(extracted, spec)
    typed = typed_rows(body, spec)
    clean, rejected = split_duplicate_batches(typed, "page_id", list(spec.keys))
    return Ingested(
        rows=clean,
        malformed=body.filter(F.col("kind") == "malformed").drop("places"),
        page_status=extracted.select("page_id", "season", "is_playoff", "status"),
        rejected_pages=rejected,
    )


def ingest_shot_pages(pages: DataFrame, tasks: DataFrame) -> Ingested:
    extracted = staged(extract_shots(pages_of_tasks(pages, tasks)), SHOTS.name)
    points = shot_rows(extracted)
    clean, rejected = split_duplicate_batches(typed_shots(points), "page_id", list(SHOTS.keys))
    return Ingested(
        rows=clean,
        malformed=points.filter(F.col("kind") == "malformed"),
        page_status=extracted.select(
            "page_id", "season", F.lit(False).alias("is_playoff"), "status"
        ),
        rejected_pages=rejected,
    )


def merge_ingested(table: KeyedTable, ingested: Ingested, stamp: datetime) -> int:
    """Merge the rows of all clean pages; between pages the higher page id wins."""
    batch = last_of_duplicates(ingested.rows, list(table.spec.keys), ["page_id"])
    return table.upsert(batch, stamp)


def ingest_pages_into(
    pages: DataFrame,
    tasks: DataFrame,
    table: KeyedTable,
    stamp: datetime,
    checkpoint: str,
    log_path: str | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Continuous ingest: every micro-batch of arriving season pages is read and merged.

    Malformed rows and failing pages never stop the stream. With ``log_path`` the run log of each
    batch is kept in a folder of the batch's number.
    """

    def ingest(batch: DataFrame, batch_id: int) -> None:
        found = ingest_stat_pages(batch, tasks, table.spec)
        rows = last_of_duplicates(found.rows, list(table.spec.keys), ["page_id"])
        table.upsert(rows, stamp, commit=batch_id, stream=stream_id(batch.sparkSession, checkpoint))
        if log_path:
            run_log(found, table.spec).write.mode("overwrite").parquet(f"{log_path}/batch={batch_id}")

    writer = pages.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def run_log(ingested: Ingested, spec: TableSpec) -> DataFrame:
    """Pages per (table, season, phase, status), with the rows they contributed."""
    per_page = ingested.rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_rows"))
    rejected = ingested.rejected_pages.withColumn("_rejected", F.lit(True))
    outcome = (
        F.when(F.col("_rejected"), "duplicate_key")
        .when((F.col("status") == "ok") & F.col("n_rows").isNull(), "empty")
        .otherwise(F.col("status"))
    )
    return (
        ingested.page_status.join(per_page, "page_id", "left")
        .join(rejected, "page_id", "left")
        .groupBy("season", "is_playoff", outcome.alias("status"))
        .agg(
            F.count(F.lit(1)).alias("pages"),
            F.sum(F.coalesce("n_rows", F.lit(0))).cast("bigint").alias("n_rows"),
        )
        .select(F.lit(spec.name).alias("table_name"), "season", "is_playoff", "status", "pages", "n_rows")
    )
