"""Key checks on streams: requests meet the stream of key changes by event time."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from courtside.operators.keyvalidity import MINT, REVOKE, verdict
from courtside.streaming.live import append_into, event_time

_POLICY = "spark.sql.streaming.multipleWatermarkPolicy"


def judged_stream(
    requests: DataFrame, changes: DataFrame, delay: str = "10 minutes", request_id: str = "request_id"
) -> DataFrame:
    """The requests of a stream with ``verdict`` and ``api_key_id``, by a stream of key changes.

    Two interval joins: a request waits until the watermark has passed its time, so that every mint and
    every revocation up to then, arriving within ``delay``, is known; then it leaves the state. Of the changes the
    state keeps one row a mint and one a revocation, which is the key table itself. A hash is minted under one id.
    A change that is logged again meets a request again, with the same verdict; ``request_id`` tells such rows apart.
    """
    asked = event_time(requests, delay)
    minted = _changes(changes, MINT, delay).select(F.col("id").alias("_key_id"), F.col("hash").alias("_key_hash"), F.col("at").alias("_minted_at"))
    ended = _changes(changes, REVOKE, delay).select(F.col("id").alias("_ended_id"), F.col("at").alias("_ended_at"))
    known = asked.join(minted, (F.col("hash") == F.col("_key_hash")) & (F.col("_minted_at") <= F.col("ts")), "left_outer")
    # One time of events from here on: that of the request.
    known = known.drop("_key_hash", "_minted_at")
    met = known.join(ended, (F.col("_key_id") == F.col("_ended_id")) & (F.col("_ended_at") <= F.col("ts")), "left_outer")
    valid = F.col("_key_id").isNotNull() & F.col("_ended_id").isNull()
    return met.withColumns(
        {"verdict": verdict(F.col("_key_id").isNotNull(), valid), "api_key_id": F.when(valid, F.col("_key_id"))}
    ).drop("_key_id", "_ended_id", "_ended_at").dropDuplicatesWithinWatermark([request_id])


def _changes(changes: DataFrame, kind: str, delay: str) -> DataFrame:
    wanted = changes.where(F.col("kind") == kind)
    return wanted.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", delay)


@contextmanager
def _one_clock(spark: SparkSession) -> Iterator[None]:
    """Queries started inside take the newest of their streams as the clock: changes are rare, and
    the slowest stream would hold requests back until the next change."""
    before = spark.conf.get(_POLICY, None)
    spark.conf.set(_POLICY, "max")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_POLICY)
        else:
            spark.conf.set(_POLICY, before)


def append_judged(
    requests: DataFrame, changes: DataFrame, columns: list[str], path: str, checkpoint: str, delay: str = "10 minutes",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Appends judged requests to Parquet files exactly once. Times come back without a zone."""
    shown = judged_stream(requests, changes, delay).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    with _one_clock(requests.sparkSession):
        return append_into(shown.select(*columns), path, checkpoint, trigger)
