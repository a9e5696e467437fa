"""Reset-aware increase of counters on arriving samples.

For each series the state keeps the time and value of its last sample, so the step from one micro-batch to the next is
counted like any other. A series that is silent for long is forgotten by a timer and then begins anew.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from courtside.operators.telemetry import SERIES
from courtside.streaming.live import append_into

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LastSample(StatefulProcessor):
    """Steps between the samples of one series; samples not after the last one are left out and counted."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "micros bigint, value bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        samples = pd.concat(list(rows)).sort_values(["micros", "value"], kind="stable")
        micros, value = self.last.get() if self.last.exists() else (None, None)
        increase = late = 0
        for at, now in zip(samples["micros"].tolist(), samples["value"].tolist()):
            if micros is not None and at <= micros:
                late += 1
                continue
            if value is not None:
                # A drop means that the counter began again from zero.
                increase += now - value if now >= value else now
            micros, value = at, now
        self.last.update((micros, value))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(micros // 1000 + self.idle_ms)
        yield pd.DataFrame([[*key, micros, increase, late]], columns=[*SERIES, "upto_micros", "increase", "late"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def live_increase(samples: DataFrame, idle: str = "7 days", delay: str = "1 day") -> DataFrame:
    """(series, upto, increase, late): what each micro-batch adds to each of its series.

    ``samples``: the series' labels, ts and value; those without a time or value are left out. ``delay`` bounds how old a
    sample may be, ``idle`` after how long without one a series is forgotten. ``upto`` is the time of the last sample
    and ``late`` the number of samples that came after a newer one.
    """
    usable = samples.where(F.col("ts").isNotNull() & F.col("value").isNotNull())
    timed = usable.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    timed = timed.select(*SERIES, "ts", F.unix_micros("ts").alias("micros"), F.col("value").cast("bigint").alias("value"))
    idle_ms = pd.Timedelta(idle) // pd.Timedelta("1ms")
    found = timed.groupBy(*SERIES).transformWithStateInPandas(
        statefulProcessor=LastSample(idle_ms),
        outputStructType=f"{', '.join(f'{label} string' for label in SERIES)}, upto_micros bigint, increase bigint, late bigint",
        outputMode="Append",
        timeMode="EventTime",
    )
    upto = F.timestamp_micros("upto_micros").cast("timestamp_ntz").alias("upto")
    return found.select(*SERIES, upto, "increase", "late")


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep state with timers, which needs the RocksDB store."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)


def append_increase(
    samples: DataFrame, path: str, checkpoint: str, idle: str = "7 days", delay: str = "1 day", trigger: dict | None = None
) -> StreamingQuery:
    """Appends what each micro-batch adds to Parquet files, exactly once; a series' increase is their sum."""
    with _state_on_disk(samples.sparkSession):
        return append_into(live_increase(samples, idle, delay), path, checkpoint, trigger)
