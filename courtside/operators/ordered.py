"""Ordered analytics that stay parallel inside one series.

A series (one label set) may hold a large share of all rows, so none of these put a
whole series into a single window partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def running_sum(
    rows: DataFrame, series: list[str], ts: str, value: str, output: str, chunk: str = "day"
) -> DataFrame:
    """Running sum per series in ``ts`` order, in two levels.

    Chunk totals are accumulated first (one row per series and chunk), then each chunk
    adds its own prefix. (series, ts) must be unique, so a chunk has bounded length.
    """
    chunked = rows.withColumn("_chunk", F.date_trunc(chunk, ts).cast("timestamp_ntz"))
    before = Window.partitionBy(*series).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        chunked.groupBy(*series, "_chunk")
        .agg(F.sum(value).alias("_total"))
        .select(*series, "_chunk", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy(*series, "_chunk").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    local = chunked.withColumn("_local", F.sum(value).over(inside))
    return (
        local.join(offsets, [*series, "_chunk"])
        .withColumn(output, (F.col("_before") + F.col("_local")).cast("bigint"))
        .drop("_chunk", "_before", "_local")
    )


def running_count(
    rows: DataFrame, series: list[str], order: list[str], output: str, chunk: str = "hour"
) -> DataFrame:
    """1, 2, 3, ... per series in ``order`` (unique within the series; its first column is a time).

    Rows are numbered within (series, chunk of time), and each chunk adds the count of the chunks
    before it. A finer ``chunk`` spreads a hotter series.
    """
    chunked = rows.withColumn("_chunk", F.date_trunc(chunk, order[0]).cast("timestamp_ntz"))
    before = Window.partitionBy(*series).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        chunked.groupBy(*series, "_chunk")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            *[F.col(c).alias(f"_of_{c}") for c in series],
            F.col("_chunk").alias("_of_chunk"),
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        )
    )
    inside = Window.partitionBy(*series, "_chunk").orderBy(*order)
    local = chunked.withColumn("_local", F.row_number().over(inside))
    same = F.col("_chunk").eqNullSafe(F.col("_of_chunk"))
    for column in series:
        same = same & F.col(column).eqNullSafe(F.col(f"_of_{column}"))
    counted = local.join(offsets, same).withColumn(output, (F.col("_before") + F.col("_local")).cast("bigint"))
    return counted.select(*rows.columns, output)


def _step(value: Column, previous: Column) -> Column:
    """Counter step: a drop means the counter restarted from zero."""
    return (
        F.when(previous.isNull(), F.lit(0))
        .when(value >= previous, value - previous)
        .otherwise(value)
    )


def counter_increase(
    samples: DataFrame, series: list[str], ts: str = "ts", value: str = "value", chunk: str = "day"
) -> DataFrame:
    """Reset-aware increase per series; the first sample contributes nothing.

    Steps are summed inside time chunks, then the joint between neighbouring chunks is
    added from each chunk's first and last value.
    """
    chunked = samples.withColumn("_chunk", F.date_trunc(chunk, ts).cast("timestamp_ntz"))
    inside = Window.partitionBy(*series, "_chunk").orderBy(ts)
    stepped = chunked.withColumn("_inc", _step(F.col(value), F.lag(value).over(inside)))
    per_chunk = stepped.groupBy(*series, "_chunk").agg(
        F.sum("_inc").alias("_inc"),
        F.min_by(value, ts).alias("_first"),
        F.max_by(value, ts).alias("_last"),
    )
    across = Window.partitionBy(*series).orderBy("_chunk")
    joint = _step(F.col("_first"), F.lag("_last").over(across))
    return (
        per_chunk.withColumn("_inc", F.col("_inc") + joint)
        .groupBy(*series)
        .agg(F.sum("_inc").alias("increase"))
    )


def last_per_key(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The row that sorts first under ``order`` for each key.

    Spark trims each task to one row per key ahead of the shuffle (WindowGroupLimit),
    so many copies of one key never meet in a single task.
    """
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rank") == 1).drop("_rank")
