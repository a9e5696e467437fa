from datetime import datetime

from pyspark.sql import functions as F

from courtside.checks import feeds
from courtside.operators import credentials as cred
from courtside.operators.keyedtable import KeyedTable
from courtside.operators.telemetry import COUNTER_LABELS, histogram_rows, latency_histogram
from courtside.schemas import SHOTS
from courtside.streaming import live

STAMP = datetime(2024, 6, 1)


def split_events(spark, sf_dir, folder, parts=4):
    """The event table as several files, in time order, so that a stream sees several batches."""
    rows = feeds.source(spark, sf_dir, "events").withColumn("part", F.expr(f"event_id * {parts} div 1000"))
    for part in range(parts):
        rows.filter(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(folder)


def run(spark, tmp_path, stream, spec, mode="update"):
    store = KeyedTable(spark, f"file://{tmp_path}/{spec.name}", spec)
    query = live.merge_into(stream, store, STAMP, f"{tmp_path}/{spec.name}-checkpoint", mode)
    query.awaitTermination()
    return store, query


def streamed(spark, sf_dir, tmp_path):
    folder = f"{tmp_path}/events"
    split_events(spark, sf_dir, folder)
    schema = feeds.source(spark, sf_dir, "events").schema
    return live.parquet_stream(spark, folder, schema, maxFilesPerTrigger="1")


def same(found, expected, columns):
    return sorted(map(tuple, found.select(*columns).collect())) == sorted(map(tuple, expected.select(*columns).collect()))


def test_streams_equal_batches(spark, sf_dir, tmp_path):
    events = streamed(spark, sf_dir, tmp_path)
    batch = feeds.requests(feeds.source(spark, sf_dir, "events"))

    store, _ = run(spark, tmp_path, live.live_counts(feeds.requests(events)), live.COUNTS)
    assert store.version() == 4
    expected = batch.groupBy(*COUNTER_LABELS).agg(F.count(F.lit(1)).alias("n"))
    assert same(store.read(), expected, [*COUNTER_LABELS, "n"])

    store, query = run(
        spark, tmp_path, live.live_windows(feeds.requests(events), "15 seconds", delay="40 days"), live.WINDOWED_COUNTS
    )
    expected = batch.groupBy(F.window("ts", "15 seconds").alias("w"), *COUNTER_LABELS).agg(F.count(F.lit(1)).alias("n"))
    expected = expected.select(F.col("w.start").alias("window_start"), *COUNTER_LABELS, "n")
    assert same(store.read(), expected, ["window_start", *COUNTER_LABELS, "n"])
    assert live.rows_dropped_as_late(query) == 0

    store, _ = run(spark, tmp_path, live.live_histogram(feeds.requests(events)), live.HISTOGRAM)
    assert same(histogram_rows(store.read()), latency_histogram(batch), ["method", "endpoint", "le", "n"])

    store, _ = run(spark, tmp_path, feeds.shots(events).select(*SHOTS.names), SHOTS, "append")
    assert same(store.read(), feeds.shots(feeds.source(spark, sf_dir, "events")), SHOTS.names)


def test_key_check_on_a_stream(spark, sf_dir, tmp_path):
    events, keys = streamed(spark, sf_dir, tmp_path), feeds.credentials(spark, sf_dir)
    found = cred.authorised(feeds.requests(events), keys).select("request_id")
    live.append_into(found, f"{tmp_path}/rows", f"{tmp_path}/checkpoint").awaitTermination()
    expected = cred.authorised(feeds.requests(feeds.source(spark, sf_dir, "events")), keys)
    assert same(spark.read.parquet(f"{tmp_path}/rows"), expected, ["request_id"])


def test_late_rows_are_counted(spark, tmp_path):
    folder, shape = f"{tmp_path}/late", "ts timestamp_ntz, method string, endpoint string, status string"
    label = ("GET", "/a", "200")
    for day in (10, 20, 1):
        spark.createDataFrame([(datetime(2024, 1, day), *label)], shape).coalesce(1).write.mode("append").parquet(folder)
    stream = live.parquet_stream(spark, folder, spark.read.parquet(folder).schema, maxFilesPerTrigger="1")
    store, query = run(spark, tmp_path, live.live_windows(stream, "15 seconds", delay="1 hour"), live.WINDOWED_COUNTS)
    assert store.read().agg(F.sum("n")).first()[0] + live.rows_dropped_as_late(query) == 3
    assert live.rows_dropped_as_late(query) == 1


def shots_of(spark, sf_dir, points=0):
    rows = feeds.shots(feeds.source(spark, sf_dir, "events")).select(*SHOTS.names)
    return rows.withColumn("team_score", F.col("team_score") + points)


def arriving(spark, rows, folder, parts=1):
    for part in range(parts):
        some = rows.where(F.pmod(F.xxhash64(*SHOTS.keys), F.lit(parts)) == part)
        some.coalesce(1).write.mode("append").parquet(folder)
    return live.parquet_stream(spark, folder, rows.schema, maxFilesPerTrigger="1")


def test_stream_onto_a_filled_table(spark, sf_dir, tmp_path):
    store = KeyedTable(spark, f"file://{tmp_path}/t", SHOTS)
    store.upsert(shots_of(spark, sf_dir, 1).where("result"), STAMP)
    store.upsert(shots_of(spark, sf_dir, 1).where("not result and `left` % 2 = 0"), STAMP)
    stream = arriving(spark, shots_of(spark, sf_dir), f"{tmp_path}/in", 3)
    live.merge_into(stream, store, STAMP, f"{tmp_path}/c1", "append").awaitTermination()
    assert store.version() == 5
    assert same(store.read(), shots_of(spark, sf_dir), SHOTS.names)
    # A batch in between, then the stream goes on with a new file; nothing old comes again.
    store.upsert(shots_of(spark, sf_dir, 2), STAMP)
    shots_of(spark, sf_dir, 3).limit(1).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    live.merge_into(stream, store, STAMP, f"{tmp_path}/c1", "append").awaitTermination()
    assert store.version() == 7
    # A new checkpoint is a new stream: all its batches count.
    live.merge_into(stream, store, STAMP, f"{tmp_path}/c2", "append").awaitTermination()
    assert store.version() == 11


def test_replay_after_a_lost_checkpoint_entry(spark, sf_dir, tmp_path):
    store = KeyedTable(spark, f"file://{tmp_path}/t", SHOTS)
    store.upsert(shots_of(spark, sf_dir).limit(5), STAMP, commit=0, stream="s")
    assert store.upsert(shots_of(spark, sf_dir).limit(9), STAMP, commit=0, stream="s") == 1
    assert store.upsert(shots_of(spark, sf_dir).limit(9), STAMP, commit=0, stream="other") == 2


def test_commits_do_not_depend_on_success_markers(spark, sf_dir, tmp_path):
    configuration = spark.sparkContext._jsc.hadoopConfiguration()
    configuration.set("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    try:
        store = KeyedTable(spark, f"file://{tmp_path}/t", SHOTS)
        assert store.upsert(shots_of(spark, sf_dir).limit(10), STAMP) == 1
        assert store.upsert(shots_of(spark, sf_dir), STAMP) == 2
        assert same(store.read(), shots_of(spark, sf_dir), SHOTS.names)
    finally:
        configuration.unset("mapreduce.fileoutputcommitter.marksuccessfuljobs")


def test_a_key_twice_in_a_micro_batch(spark, sf_dir, tmp_path):
    both = shots_of(spark, sf_dir).limit(4).unionByName(shots_of(spark, sf_dir, 5).limit(4))
    stream = arriving(spark, both, f"{tmp_path}/in")
    store = KeyedTable(spark, f"file://{tmp_path}/t", SHOTS)
    query = live.merge_into(
        stream, store, STAMP, f"{tmp_path}/c", "append", on_duplicate="last", order=["team_score"]
    )
    query.awaitTermination()
    held = {tuple(r[k] for k in SHOTS.keys): r.team_score for r in store.read().collect()}
    top = {}
    for r in both.collect():
        key = tuple(r[k] for k in SHOTS.keys)
        top[key] = max(top.get(key, -1), r.team_score)
    assert held == top
