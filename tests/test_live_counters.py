from datetime import datetime, timedelta

from courtside.operators.ordered import counter_increase
from courtside.operators.telemetry import SERIES
from courtside.streaming.counters import append_increase
from courtside.streaming.live import parquet_stream

SCHEMA = ", ".join(f"{label} string" for label in SERIES) + ", ts timestamp_ntz, value bigint"


def sample(series, hour, value):
    at = None if hour is None else datetime(2024, 1, 1) + timedelta(hours=hour)
    return ("j", series, "GET", "/", None if series == "n" else "200", at, value)


def run(spark, folder, parts, **options):
    rows = [sample(*s) for part in parts for s in part]
    for part in parts:
        spark.createDataFrame([sample(*s) for s in part], SCHEMA).repartition(2).write.mode("append").parquet(f"{folder}/arriving")
        stream = parquet_stream(spark, f"{folder}/arriving", spark.createDataFrame([], SCHEMA).schema)
        append_increase(stream, f"{folder}/steps", f"{folder}/checkpoint", **options).awaitTermination()
    found = spark.read.parquet(f"{folder}/steps").groupBy(*SERIES).agg({"increase": "sum", "late": "sum"})
    return {row.instance: (row["sum(increase)"], row["sum(late)"]) for row in found.collect()}, spark.createDataFrame(rows, SCHEMA)


def test_stream_equals_batch_with_resets_at_the_edges(spark, tmp_path):
    parts = [
        [("a", 1, 5), ("a", 0, 3), ("b", 2, 7), ("n", 1, 1), ("b", None, 9), ("b", 3, None)],
        [("a", 5, 2), ("a", 6, 2), ("b", 4, 7), ("c", 4, 100)],
        [("a", 7, 1), ("b", 9, 0), ("b", 10, 4), ("n", 8, 4), ("c", 9, 130)],
    ]
    found, rows = run(spark, tmp_path, parts)
    batch = counter_increase(rows.where("ts is not null and value is not null"), SERIES)
    assert {k: v[0] for k, v in found.items()} == {row.instance: row.increase for row in batch.collect()}
    assert found["a"] == (5, 0) and found["b"] == (4, 0) and found["n"] == (3, 0) and found["c"] == (30, 0)


def test_older_samples_are_counted_and_idle_series_begin_anew(spark, tmp_path):
    parts = [[("a", 0, 10), ("b", 0, 10)], [("a", 3, 15), ("a", 2, 12)], [("a", 1, 11)], [("a", 30, 20)], [("b", 31, 90), ("a", 31, 21)]]
    found, _ = run(spark, tmp_path, parts, idle="12 hours", delay="1 hour")
    assert found["a"][0] in (5 + 1, 5 + 5 + 1) and found["b"] == (0, 0)
