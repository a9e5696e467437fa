"""Window counts of a stream with the late requests set aside, each one.

A micro-batch is judged by the watermark of the batches before it: their newest event time less the delay.
A request whose window had closed by then is late and goes to a table of its own; the others are counted.
Judging comes first and is by row, so neither result depends on how files and tasks divide a batch. What a
batch adds is stored under its number, and a replayed batch replaces itself; totals add the batches up.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from courtside.operators.telemetry import COUNTER_LABELS
from courtside.workspace import create_once, names_in, read_small


@dataclass
class LateCounts:
    """Counts, late requests and the clock of one stream below ``path``."""

    spark: SparkSession
    path: str
    width: str = "1 hour"
    delay: str = "10 minutes"

    def _batches(self) -> list[int]:
        return sorted(int(name.removesuffix(".json")) for name in names_in(self.spark, f"{self.path}/clock"))

    def watermark(self, batch_id: int) -> int | None:
        """Newest event time, in microseconds, of the batches before this one; None before there is any.

        A batch's clock holds the newest time up to it, so the last one before says all.
        """
        earlier = [batch for batch in self._batches() if batch < batch_id]
        return json.loads(read_small(self.spark, f"{self.path}/clock/{earlier[-1]}.json")) if earlier else None

    def take(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch: late rows aside, the others counted, the clock moved on."""
        newest = self.watermark(batch_id)
        window = F.window(F.col("ts").cast("timestamp"), self.width)
        timed = batch.withColumn("window_start", window["start"].cast("timestamp_ntz"))
        if newest is None:
            late = F.lit(False)
        else:
            mark = F.timestamp_micros(F.lit(newest)) - F.expr(f"INTERVAL {self.delay}")
            late = window["end"] <= mark
        judged = batch.withColumn("_late", F.coalesce(late, F.lit(False)))
        judged.where("_late").drop("_late").write.mode("overwrite").parquet(f"{self.path}/late/batch={batch_id}")
        counted = timed.where(~F.coalesce(late, F.lit(False))).groupBy("window_start", *COUNTER_LABELS).agg(F.count(F.lit(1)).alias("n"))
        counted.write.mode("overwrite").parquet(f"{self.path}/counts/batch={batch_id}")
        seen = batch.agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0]
        if seen is not None or newest is not None:
            known = max(time for time in (seen, newest) if time is not None)
            create_once(self.spark, f"{self.path}/clock/{batch_id}.json", json.dumps(known))

    def _stored(self, kind: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{kind}").drop("batch")

    def counts(self) -> DataFrame:
        return self._stored("counts").groupBy("window_start", *COUNTER_LABELS).agg(F.sum("n").alias("n"))

    def late(self) -> DataFrame:
        """The late requests themselves."""
        return self._stored("late")

    def run(self, requests: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
        writer = requests.writeStream.foreachBatch(self.take).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()
