"""Structured Streaming forms of the request telemetry, key check and upsert."""

from __future__ import annotations

import json
import threading
from collections import Counter
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from courtside.operators.keyedtable import KeyedTable
from courtside.operators.ordered import running_sum
from courtside.operators.telemetry import (
    BUCKET_BOUNDS,
    COUNTER_LABELS,
    HISTOGRAM_LABELS,
    latency_histogram_wide,
)
from courtside.schemas import DOUBLE, LONG, TEXT, TableSpec
from courtside.workspace import read_small

_LABELS = [(name, TEXT, name, ()) for name in COUNTER_LABELS]
_WINDOW = [("window_start", T.TimestampNTZType(), "windowStart", ()), ("day", T.DateType(), "day", ())]
_BUCKETS = [(f"le_{i}", LONG, f"le{i}", ()) for i in range(len(BUCKET_BOUNDS) + 1)]

COUNTS = TableSpec(
    name="request_counts",
    columns=(*_LABELS, ("n", LONG, "n", ())),
    keys=tuple(COUNTER_LABELS),
    partition_by=(),
)
WINDOWED_COUNTS = TableSpec(
    name="request_window_counts",
    columns=(*_WINDOW, *_LABELS, ("n", LONG, "n", ())),
    keys=("window_start", *COUNTER_LABELS),
    partition_by=("day",),
)
HISTOGRAM = TableSpec(
    name="request_latency",
    columns=(
        *[(name, TEXT, name, ()) for name in HISTOGRAM_LABELS],
        *_BUCKETS,
        ("duration_sum", DOUBLE, "sum", ()),
        ("duration_count", LONG, "count", ()),
    ),
    keys=tuple(HISTOGRAM_LABELS),
    partition_by=(),
)


def parquet_stream(
    spark: SparkSession, folder: str, schema: T.StructType, name_glob: str = "*.parquet", **options
) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name_glob)
    return reader.options(**options).parquet(folder)


def event_time(rows: DataFrame, delay: str) -> DataFrame:
    """Watermark on ``ts``, which must be a zoned timestamp to carry one."""
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def live_counts(requests: DataFrame) -> DataFrame:
    return requests.groupBy(*COUNTER_LABELS).agg(F.count(F.lit(1)).alias("n"))


def live_windows(
    requests: DataFrame, width: str = "15 seconds", slide: str | None = None, delay: str = "10 minutes"
) -> DataFrame:
    """Counts per event-time window: tumbling, or trailing when a slide is given.

    ``delay`` bounds both the wait for late requests and the state kept.
    """
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    counted = (
        event_time(requests, delay)
        .groupBy(span.alias("w"), *COUNTER_LABELS)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    start = F.col("w.start").cast("timestamp_ntz")
    return counted.select(
        start.alias("window_start"), start.cast("date").alias("day"), *COUNTER_LABELS, "n"
    )


def trailing_counts(partial: DataFrame, width_s: int, slide_s: int) -> DataFrame:
    """Counts of trailing windows from counts of windows as wide as the slide.

    A stream keeps one count per slide, whatever the width. A trailing window is the difference of two prefix
    sums: a partial count enters at the first window that holds it and leaves after the last one, which is
    two rows for any width. Their running sum is the count from one such change to the next, and only the result
    lists the windows between.
    """
    if width_s % slide_s:
        raise ValueError("the width must be a whole number of slides")

    def shifted(start: Column, seconds: int) -> Column:
        return start + F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)"))

    start, at = F.col("window_start"), F.col("_at")
    changes = partial.select(
        *COUNTER_LABELS,
        F.inline(
            F.array(
                F.struct(shifted(start, slide_s - width_s).alias("_at"), F.col("n").alias("_change")),
                F.struct(shifted(start, slide_s).alias("_at"), (-F.col("n")).alias("_change")),
            )
        ),
    )
    # One row for each series and slide mark at most, however many requests there were.
    summed = changes.groupBy(*COUNTER_LABELS, "_at").agg(F.sum("_change").alias("_change"))
    counted = running_sum(summed, COUNTER_LABELS, "_at", "_change", "n")
    following = F.lead("_at").over(Window.partitionBy(*COUNTER_LABELS).orderBy("_at"))
    pieces = counted.withColumn("_next", following).where("n > 0")
    step = F.make_dt_interval(secs=F.lit(slide_s).cast("decimal(18,6)"))
    starts = F.sequence(at, shifted(F.col("_next"), -slide_s), step)
    return pieces.select(F.explode(starts).alias("window_start"), *COUNTER_LABELS, "n")


def live_histogram(requests: DataFrame) -> DataFrame:
    return latency_histogram_wide(requests)


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id a stream keeps with its checkpoint."""
    return json.loads(read_small(spark, f"{checkpoint}/metadata"))["id"]


def merge_into(
    stream: DataFrame,
    table: KeyedTable,
    stamp: datetime,
    checkpoint: str,
    mode: str = "update",
    trigger: dict | None = None,
    on_duplicate: str = "error",
    order: list[str] | None = None,
) -> StreamingQuery:
    """Upsert every micro-batch.

    A batch is known to the table by the stream's own id, kept with its checkpoint, and its number
    there; so a replay changes nothing, and a new checkpoint is a new stream. ``on_duplicate``
    and ``order`` say what becomes of a key that a micro-batch holds twice.
    """
    spark = stream.sparkSession

    def upsert(batch: DataFrame, batch_id: int) -> None:
        table.upsert(batch, stamp, on_duplicate, order, commit=batch_id, stream=stream_id(spark, checkpoint))

    _watch(spark)
    writer = stream.writeStream.outputMode(mode).foreachBatch(upsert)
    return writer.option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})
    ).start()


def append_into(
    stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Append rows to Parquet files exactly once, for row-wise results and closed windows."""
    _watch(stream.sparkSession)
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", path)
    return writer.option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})
    ).start()


class LateRows(StreamingQueryListener):
    """Adds up the rows the watermark discarded, over all progress reports of each run.

    An aggregation drops rows after its partial counts, so one dropped row may stand for several
    requests of one window and label set.
    """

    def __init__(self) -> None:
        self._dropped: Counter[str] = Counter()
        self._ended: set[str] = set()
        self._news = threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        with self._news:
            self._dropped[str(event.progress.runId)] += sum(
                operator.numRowsDroppedByWatermark for operator in event.progress.stateOperators
            )

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._news:
            self._ended.add(str(event.runId))
            self._news.notify_all()

    def dropped(self, query: StreamingQuery, wait: float = 30.0) -> int:
        """Rows dropped so far; of an ended query all of them, as its last report comes before its end."""
        run = str(query.runId)
        with self._news:
            if not query.isActive and not self._news.wait_for(lambda: run in self._ended, wait):
                raise TimeoutError("the end of the query was not reported")
            return self._dropped[run]


_listeners: dict[str, LateRows] = {}


def _watch(spark: SparkSession) -> LateRows:
    """The session's counter of late rows, listening since before its first query."""
    key = f"{spark.sparkContext.applicationId} {id(spark._jsparkSession)}"
    if key not in _listeners:
        _listeners[key] = LateRows()
        spark.streams.addListener(_listeners[key])
    return _listeners[key]


def rows_dropped_as_late(query: StreamingQuery, spark: SparkSession | None = None) -> int:
    """Rows the watermark of a run discarded, started by this module in ``spark`` (else the active session)."""
    return _watch(spark or SparkSession.active()).dropped(query)
