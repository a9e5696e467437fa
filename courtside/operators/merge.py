"""Keyed merge of batches into tables, with the constraint checks around it."""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F

from courtside.operators.ordered import last_per_key
from courtside.schemas import TableSpec


# Prune values of a batch that are named one by one to the target; with more of them the whole target is joined.
NAMED_VALUES = 1000
# Keys, and wide rows, that a task holds in memory at ease.
KEYS_PER_TASK, ROWS_PER_TASK = 500_000, 250_000


class DuplicateKeyError(ValueError):
    """One batch holds the same key more than once."""


def dealt_keys(rows: DataFrame, keys: list[str], total: int) -> DataFrame:
    """The bare keys of about ``total`` rows, all rows of a key in one task, for keys that seldom repeat.

    Counting such keys ahead of a shuffle fills memory and makes the rows no fewer. They are dealt out by number, since
    Spark would join ranges that are small when compressed to tasks whose counts spill.
    """
    return rows.select(*keys).repartition(max(1, -(-total // KEYS_PER_TASK)), *keys)


def duplicate_keys(rows: DataFrame, keys: list[str], total: int | None = None) -> DataFrame:
    """Keys that occur more than once, with their counts.

    Partial counts go before the shuffle, unless ``total`` says how many rows there are whose keys seldom repeat.
    """
    rows = rows if total is None else dealt_keys(rows, keys, total)
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def null_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """NOT NULL audit: one row with the number of nulls per column."""
    return rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])


def last_of_duplicates(batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return last_per_key(batch, keys, *[F.col(c).desc_nulls_last() for c in order])


def split_duplicate_batches(
    rows: DataFrame, batch_column: str, keys: list[str]
) -> tuple[DataFrame, DataFrame]:
    """(rows of clean batches, ids of batches rejected because a key repeats in them)."""
    rejected = (
        duplicate_keys(rows, [batch_column, *keys]).select(batch_column).distinct()
    )
    return rows.join(rejected, batch_column, "left_anti"), rejected


def unique_batch(
    batch: DataFrame,
    spec: TableSpec,
    on_duplicate: str = "error",
    order: list[str] | None = None,
    total: int | None = None,
) -> DataFrame:
    if on_duplicate == "last":
        if not order:
            raise ValueError("on_duplicate='last' needs order columns")
        return last_of_duplicates(batch, list(spec.keys), order)
    if on_duplicate != "error":
        raise ValueError(f"unknown duplicate policy: {on_duplicate}")
    clash = duplicate_keys(batch, list(spec.keys), total).limit(1).collect()
    if clash:
        raise DuplicateKeyError(f"{spec.name}: key occurs more than once: {clash[0].asDict()}")
    return batch


def with_audit(batch: DataFrame, stamp: datetime | Column) -> DataFrame:
    """Audit stamps for new rows, from a given batch time so that a replay is identical."""
    at = stamp if isinstance(stamp, Column) else F.lit(stamp).cast("timestamp_ntz")
    return batch.withColumns(
        {"created_at": at, "updated_at": at, "deleted_at": F.lit(None).cast("timestamp_ntz")}
    )


def merge_rows(
    target: DataFrame, batch: DataFrame, spec: TableSpec, small_batch: bool = False
) -> DataFrame:
    """Target after the batch: payload columns of matched keys replaced, new keys added.

    Keys and audit columns of an existing row stay as they are, also on soft-deleted rows.
    The default form shuffles both sides once (full outer join on the key).
    ``small_batch`` says the batch is small next to the target: then the target is
    streamed past the batch twice and Spark broadcasts the batch if its size allows, and the rows of partitions
    that the batch does not reach pass by unjoined.
    Both forms give the same rows.
    """
    columns = target.columns
    keys, updates = list(spec.keys), set(spec.updates)
    if small_batch:
        reached = _reached(batch, spec)
        if reached is None:
            return _merge_streaming(target, batch, keys, updates, columns)
        return _merge_streaming(target.where(reached), batch, keys, updates, columns).unionByName(target.where(~reached))
    fresh = batch.select(
        *[F.col(k) for k in keys],
        *[F.col(c).alias(f"_new_{c}") for c in columns if c not in keys],
        F.lit(True).alias("_in_batch"),
    )
    current = target.withColumn("_in_target", F.lit(True))
    joined = current.join(fresh, keys, "full_outer")
    return joined.select(*[_merged(c, keys, updates, F.col("_in_target").isNull()) for c in columns])


def merge_ranges(target: DataFrame | None, batch: DataFrame, spec: TableSpec, order: list[str], total: int) -> DataFrame:
    """The rows of ``merge_rows`` for sides with unique keys, sorted by ``order`` inside ranges of it.

    ``order`` is the whole key and columns that follow from it, ``total`` about the rows of both sides. The rows are
    shuffled once, into the ranges a sorted table is written in; a join would shuffle and sort them before that again.
    Without a target the batch is only dealt out.
    """
    tasks = max(1, -(-total // ROWS_PER_TASK))
    if target is None:
        return batch.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    columns, keys, updates = target.columns, set(spec.keys), set(spec.updates)
    both = target.withColumn("_in_batch", F.lit(False)).unionByName(batch.withColumn("_in_batch", F.lit(True)))
    # A key with a null meets no other, so each such row is a group of its own.
    alone = F.when(reduce(or_, [F.col(k).isNull() for k in spec.keys]), F.monotonically_increasing_id())
    replaced = [c for c in columns if c in updates and c not in order]
    carried = [c for c in columns if c not in updates and c not in keys and c not in order]
    merged = (
        both.repartitionByRange(tasks, *order)
        .withColumn("_alone", alone)
        .groupBy(*order, "_alone")
        .agg(
            F.max_by(F.struct(*replaced), "_in_batch").alias("_replaced"),
            F.min_by(F.struct(*carried), "_in_batch").alias("_carried"),
        )
    )
    place = {c: F.col("_replaced")[c] for c in replaced} | {c: F.col("_carried")[c] for c in carried}
    return merged.select(*[place.get(c, F.col(c)).alias(c) for c in columns]).sortWithinPartitions(*order)


def _merged(column: str, keys: list[str], updates: set[str], is_new: Column) -> Column:
    if column in keys:
        return F.col(column)
    incoming, current = F.col(f"_new_{column}"), F.col(column)
    if column in updates:
        return F.when(F.col("_in_batch"), incoming).otherwise(current).alias(column)
    return F.when(is_new, incoming).otherwise(current).alias(column)


def _reached(batch: DataFrame, spec: TableSpec) -> Column | None:
    """Rows whose prune columns have values that the batch holds; None where that says nothing.

    A key with a null meets no other key, so such rows are not reached.
    """
    kept = [column for column in spec.partition_by if column in spec.keys]
    found = batch.select(*kept).distinct().limit(NAMED_VALUES + 1).collect() if kept else []
    if not kept or len(found) > NAMED_VALUES:
        return None
    reached = F.lit(False)
    for values in found:
        reached = reached | reduce(and_, [F.col(c) == F.lit(v) for c, v in zip(kept, values)])
    return F.coalesce(reached, F.lit(False))


def _merge_streaming(target, batch, keys, updates, columns) -> DataFrame:
    fresh = batch.select(
        *[F.col(k) for k in keys],
        *[F.col(c).alias(f"_new_{c}") for c in columns if c in updates],
        F.lit(True).alias("_in_batch"),
    )
    kept = target.join(fresh, keys, "left").select(
        *[
            F.when(F.col("_in_batch"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
            if c in updates
            else F.col(c)
            for c in columns
        ]
    )
    matched = target.select(*keys).join(batch.select(*keys), keys, "left_semi")
    added = batch.join(matched, keys, "left_anti").select(*columns)
    return kept.unionByName(added)


def merge_actions(target: DataFrame, batch: DataFrame, spec: TableSpec) -> DataFrame:
    """Batch rows labelled ``update`` or ``insert`` by whether their key is stored."""
    known = target.select(*spec.keys).withColumn("_known", F.lit(True))
    return batch.join(known, list(spec.keys), "left").withColumn(
        "operation", F.when(F.col("_known"), F.lit("update")).otherwise(F.lit("insert"))
    ).drop("_known")


def operation_counts(actions: DataFrame, entity: str) -> DataFrame:
    """Database-operation counter by (operation, entity)."""
    return (
        actions.withColumn("entity", F.lit(entity))
        .groupBy("operation", "entity")
        .agg(F.count(F.lit(1)).alias("n"))
    )
