from datetime import datetime, timedelta
from types import SimpleNamespace

from pyspark.sql import functions as F

from courtside.operators.telemetry import COUNTER_LABELS
from courtside.streaming.latecounts import LateCounts
from courtside.streaming.live import trailing_counts

SCHEMA = "request_id bigint, ts timestamp_ntz, method string, endpoint string, status string"


def rows_at(*hours):
    start = datetime(2024, 1, 1)
    return [(round(h * 10), start + timedelta(hours=h), "GET", f"/{round(h) % 2}", "200") for h in hours]


PARTS = [rows_at(10, 10.5, 11.2), rows_at(11.3, 9.9, 8.1, 2), rows_at(1, 10.6, 15), rows_at(11.1, 14.5, 3.2, 3.3)]
# Newest times before each batch: none, 11.2, 11.3, 15 hours; less ten minutes. Windows end at the full hour.
LATE = {20, 81, 99, 10, 106, 32, 33, 111}


def test_late_requests_are_the_same_however_a_batch_is_divided(spark, tmp_path):
    found = []
    for tasks in (1, 5):
        counts = LateCounts(spark, f"{tmp_path}/tasks{tasks}")
        for batch_id, part in enumerate(PARTS):
            counts.take(spark.createDataFrame(part, SCHEMA).repartition(tasks), batch_id)
            counts.take(spark.createDataFrame(part, SCHEMA), batch_id)  # a replay changes nothing
        late = sorted(row.request_id for row in counts.late().collect())
        found.append((late, sorted(map(tuple, counts.counts().collect()))))
    assert found[0] == found[1]
    assert set(found[0][0]) == LATE and len(found[0][0]) == len(LATE)
    assert sum(row[-1] for row in found[0][1]) == sum(map(len, PARTS)) - len(LATE)


def test_empty_batches_and_times_that_are_missing(spark, tmp_path):
    counts = LateCounts(spark, f"{tmp_path}/empty")
    counts.take(spark.createDataFrame([], SCHEMA), 0)
    assert counts.watermark(1) is None
    counts.take(spark.createDataFrame([(1, None, "GET", "/", "200"), *rows_at(5)], SCHEMA), 1)
    counts.take(spark.createDataFrame([], SCHEMA), 2)
    counts.take(spark.createDataFrame(rows_at(1), SCHEMA), 3)
    assert [row.request_id for row in counts.late().collect()] == [10]


def test_trailing_counts_by_differences_equal_every_window(spark):
    start = datetime(2024, 1, 1, 23, 50)
    times = [0, 1, 2, 9, 10, 30, 31, 300, 301]
    partial = [(start + timedelta(minutes=5 * t), "GET", f"/{k}", "200", t % 4 + 1) for t in times for k in range(2)]
    frame = spark.createDataFrame(partial, f"window_start timestamp_ntz, {', '.join(f'{c} string' for c in COUNTER_LABELS)}, n bigint")
    for width in (5, 15, 60):
        want = {}
        for at, *labels, n in partial:
            for k in range(width // 5):
                key = (at - timedelta(minutes=5 * k), *labels)
                want[key] = want.get(key, 0) + n
        found = trailing_counts(frame, width * 60, 300)
        rows = found.select("window_start", *COUNTER_LABELS, "n").collect()
        assert len(rows) == len(want) and {tuple(r[:-1]): r[-1] for r in rows} == want
    assert trailing_counts(frame.limit(0), 900, 300).count() == 0
