"""Request counters, histograms, dashboard reductions and their streaming forms."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from courtside.checks import feeds
from courtside.checks.registry import columns, events, query
from courtside.operators import credentials as cred
from courtside.operators import telemetry as tm
from courtside.operators.keyedtable import KeyedTable
from courtside.schemas import SHOTS
from courtside.sources.requestlog import parse_request_lines
from courtside.streaming import live
from courtside.workspace import scratch_path, session_setting, staged

STAMP = datetime(2024, 6, 1)
ENDPOINT = "/api/playeradvancedstats/"
_SERIES = "job, instance, method, endpoint, status"
AS_OF = "2024-01-20 12:00:00"


def requests(spark, d):
    return feeds.requests(events(spark, d))


def samples(spark, d):
    return feeds.samples(events(spark, d))


@query(
    "filter_labels",
    f"SELECT request_id, instance, status FROM lg_requests WHERE endpoint = '{ENDPOINT}' AND status = '200'",
)
def filter_labels(spark, d):
    return requests(spark, d).filter(tm.label_filter(endpoint=ENDPOINT, status="200")).select(
        "request_id", "instance", "status"
    )


@query("filter_job_label", "SELECT job, count(*) AS n FROM lg_requests WHERE job = 'stats-api' GROUP BY 1")
def filter_job_label(spark, d):
    return requests(spark, d).filter(tm.label_filter(job=feeds.JOB)).groupBy("job").agg(F.count(F.lit(1)).alias("n"))


for _minutes in (5, 15):
    query(
        f"filter_last_{_minutes}_minutes",
        f"""SELECT request_id, ts FROM lg_requests WHERE ts > (SELECT max(ts) FROM events) - INTERVAL {_minutes} MINUTE
            AND ts <= (SELECT max(ts) FROM events)""",
    )(
        lambda spark, d, minutes=_minutes: requests(spark, d)
        .filter(
            tm.within(events(spark, d).agg(F.max("ts").alias("m")).scalar(), f"{minutes} MINUTES")
        )
        .select("request_id", "ts")
    )


def load_log(spark, d):
    return parse_request_lines(feeds.load_lines(events(spark, d)))


@query(
    "load_success_flags",
    """SELECT request_id, error IS NULL AND coalesce(status = 200, FALSE) AS ok FROM lg_loadlog""",
)
def load_success_flags(spark, d):
    return load_log(spark, d).select("request_id", tm.succeeded().alias("ok"))


_OK = "error IS NULL AND status = 200"


@query(
    "load_summary",
    f"""SELECT count(*) AS total, count(*) FILTER ({_OK}) AS success, count(*) - count(*) FILTER ({_OK}) AS failed,
               CAST(coalesce(sum(duration_ns) FILTER ({_OK}) // nullif(count(*) FILTER ({_OK}), 0), 0) AS BIGINT) AS mean_ns
        FROM lg_loadlog""",
)
def load_summary(spark, d):
    return tm.load_summary(load_log(spark, d))


@query(
    "load_summary_no_success",
    """SELECT count(*) AS total, CAST(0 AS BIGINT) AS success, count(*) AS failed, CAST(0 AS BIGINT) AS mean_ns
       FROM lg_loadlog WHERE error IS NOT NULL""",
)
def load_summary_no_success(spark, d):
    return tm.load_summary(load_log(spark, d).filter(F.col("error").isNotNull()))


@query(
    "requests_per_second",
    """SELECT count(*) AS total, CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS DOUBLE) / 1000000 AS wall_s,
              round(count(*) / (CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS DOUBLE) / 1000000), 9) AS rps FROM events""",
)
def requests_per_second(spark, d):
    rate = tm.requests_per_second(requests(spark, d), "ts", "ts")
    return rate.withColumn("rps", F.round("rps", 9))


@query("request_counts", "SELECT method, endpoint, status, count(*) AS n FROM lg_requests GROUP BY 1, 2, 3")
def request_counts(spark, d):
    return tm.request_counts(requests(spark, d))


def _le_sql():
    labels = [f"{bound:g}" for bound in tm.BUCKET_BOUNDS] + ["+Inf"]
    limits = [str(bound) for bound in tm.BUCKET_BOUNDS] + ["'inf'"]
    return ", ".join(f"('{label}', CAST({limit} AS DOUBLE))" for label, limit in zip(labels, limits))


@query(
    "latency_histogram",
    f"""SELECT method, endpoint, le, count(*) FILTER (duration_s <= bound) AS n, round(sum(duration_s), 6) AS duration_sum,
               count(*) AS duration_count
        FROM lg_requests CROSS JOIN (VALUES {_le_sql()}) b(le, bound) GROUP BY 1, 2, 3""",
)
def latency_histogram(spark, d):
    return tm.latency_histogram(requests(spark, d)).withColumn("duration_sum", F.round("duration_sum", 6))


_STEP, _LOOKBACK = 900, 5400
_INSTANT = f"""SELECT CAST(make_timestamp(step * 1000000) AS TIMESTAMP) AS step_ts, {_SERIES}, arg_max(value, ts) AS value
    FROM (SELECT *, unnest(range(epoch_us(ts) // 1000000, epoch_us(ts) // 1000000 + {_LOOKBACK}, {_STEP})) AS step
          FROM lg_samples) GROUP BY ALL"""


@query("instant_values", _INSTANT)
def instant_values(spark, d):
    """Newest sample per series at each step; the hourly samples fall on step marks."""
    return tm.instant_values(samples(spark, d), _STEP, _LOOKBACK)


@query(
    "instant_values_default_step",
    f"""SELECT {_SERIES}, count(*) AS steps, CAST(sum(value) AS BIGINT) AS total FROM (
          SELECT *, unnest(range(20)) AS k FROM lg_samples) GROUP BY ALL""",
)
def instant_values_default_step(spark, d):
    """15 s steps with the five-minute look-back: each lone hourly sample serves 20 steps."""
    values = tm.instant_values(samples(spark, d))
    return values.groupBy(*tm.SERIES).agg(F.count(F.lit(1)).alias("steps"), F.sum("value").alias("total"))


@query(
    "last_sample_per_bucket",
    f"""SELECT time_bucket(INTERVAL '6 hours', ts) AS bucket_ts, {_SERIES}, arg_max(value, ts) AS value
        FROM lg_samples GROUP BY ALL""",
)
def last_sample_per_bucket(spark, d):
    return tm.last_per_bucket(samples(spark, d), "6 hours")


for _label in ("instance", "endpoint", "job"):
    _where = "TRUE" if _label == "job" else f"endpoint = '{ENDPOINT}'"
    query(
        f"sum_by_{_label}",
        f"""SELECT step_ts, {_label}, CAST(sum(value) AS BIGINT) AS value FROM ({_INSTANT}) WHERE {_where} GROUP BY 1, 2""",
    )(
        lambda spark, d, label=_label: tm.sum_by(
            tm.instant_values(
                samples(spark, d).filter(
                    tm.label_filter(job=feeds.JOB) if label == "job" else tm.label_filter(endpoint=ENDPOINT)
                ),
                _STEP,
                _LOOKBACK,
            ),
            label,
        )
    )


_GAPPY = "SELECT * REPLACE (CASE WHEN hour(ts) % 5 = 0 THEN NULL ELSE value END AS value) FROM lg_samples"


def gappy(spark, d):
    """Samples with gaps: every fifth hour has no value."""
    missing = F.pmod(F.hour("ts"), F.lit(5)) == 0
    return samples(spark, d).withColumn("value", F.when(~missing, F.col("value")))


@query(
    "last_not_null",
    f"SELECT {_SERIES}, arg_max(value, ts) FILTER (value IS NOT NULL) AS last_value FROM ({_GAPPY}) GROUP BY ALL",
)
def last_not_null(spark, d):
    return tm.last_not_null(gappy(spark, d), tm.SERIES)


@query("sample_count", f"SELECT {_SERIES}, count(value) AS samples FROM ({_GAPPY}) GROUP BY ALL")
def sample_count(spark, d):
    return tm.sample_count(gappy(spark, d), tm.SERIES)


@query(
    "absolute_bands",
    """SELECT ts, instance, endpoint, status, CASE WHEN value >= 80 THEN 'red' ELSE 'green' END AS band FROM lg_samples""",
)
def absolute_bands(spark, d):
    return samples(spark, d).select("ts", "instance", "endpoint", "status", tm.absolute_band(F.col("value")).alias("band"))


@query(
    "percentage_bands",
    """SELECT ts, instance, endpoint, status, value, CASE WHEN share >= 80 THEN 'red' WHEN share >= 20 THEN 'light-blue'
                                                     ELSE 'green' END AS band
       FROM (SELECT *, coalesce(CAST((value - lo) AS DOUBLE) * 100 / nullif(hi - lo, 0), 0) AS share FROM lg_samples,
             (SELECT min(value) AS lo, max(value) AS hi FROM lg_samples))""",
)
def percentage_bands(spark, d):
    return tm.percentage_bands(samples(spark, d)).select("ts", "instance", "endpoint", "status", "value", "band")


@query(
    "counter_increase",
    f"""SELECT {_SERIES}, CAST(sum(CASE WHEN prev IS NULL THEN 0 WHEN value >= prev THEN value - prev ELSE value END) AS BIGINT)
               AS increase
        FROM (SELECT *, lag(value) OVER (PARTITION BY {_SERIES} ORDER BY ts) AS prev FROM lg_samples) GROUP BY ALL""",
)
def counter_increase(spark, d):
    return tm.increase_by_series(samples(spark, d))


@query(
    "cumulative_counter",
    """SELECT request_id, method, endpoint, status,
              row_number() OVER (PARTITION BY method, endpoint, status ORDER BY ts, request_id) AS counter FROM lg_requests""",
)
def cumulative_counter(spark, d):
    slim = requests(spark, d).select("request_id", "ts", *tm.COUNTER_LABELS)
    return tm.cumulative_requests(slim, ["ts", "request_id"]).drop("ts")


# --- streaming: each runs the stream over all available files and reads its result --------


def event_stream(spark, d):
    schema = events(spark, d).schema
    return live.parquet_stream(spark, d, schema, "events.parquet")


def _streamed(spark, stream, spec):
    root = scratch_path(spark, f"stream-{spec.name}")
    store = KeyedTable(spark, f"{root}/table", spec)
    live.merge_into(stream, store, STAMP, f"{root}/checkpoint").awaitTermination()
    return store.read()


@query("stream_request_counts", "SELECT method, endpoint, status, count(*) AS n FROM lg_requests GROUP BY 1, 2, 3")
def stream_request_counts(spark, d):
    counted = live.live_counts(feeds.requests(event_stream(spark, d)))
    return _streamed(spark, counted, live.COUNTS).select(*live.COUNTS.names)


@query(
    "stream_windows_15s",
    """SELECT time_bucket(INTERVAL '15 seconds', ts) AS window_start, method, endpoint, status, count(*) AS n
       FROM lg_requests GROUP BY 1, 2, 3, 4""",
)
def stream_windows_15s(spark, d):
    counted = live.live_windows(feeds.requests(event_stream(spark, d)), delay="1 hour")
    return _streamed(spark, counted, live.WINDOWED_COUNTS).select("window_start", *tm.COUNTER_LABELS, "n")


@query(
    "stream_trailing_15m",
    """SELECT time_bucket(INTERVAL '5 minutes', ts) - INTERVAL 5 MINUTE * k AS window_start, method, endpoint, status,
              count(*) AS n
       FROM (SELECT *, unnest(range(3)) AS k FROM lg_requests) GROUP BY 1, 2, 3, 4""",
)
def stream_trailing_15m(spark, d):
    counted = live.live_windows(feeds.requests(event_stream(spark, d)), "5 minutes", delay="1 hour")
    return live.trailing_counts(_streamed(spark, counted, live.WINDOWED_COUNTS), 15 * 60, 5 * 60)


@query(
    "stream_latency_histogram",
    f"""SELECT method, endpoint, le, count(*) FILTER (duration_s <= bound) AS n, round(sum(duration_s), 6) AS duration_sum,
               count(*) AS duration_count
        FROM lg_requests CROSS JOIN (VALUES {_le_sql()}) b(le, bound) GROUP BY 1, 2, 3""",
)
def stream_latency_histogram(spark, d):
    wide = _streamed(spark, live.live_histogram(feeds.requests(event_stream(spark, d))), live.HISTOGRAM)
    return tm.histogram_rows(wide).withColumn("duration_sum", F.round("duration_sum", 6))


@query(
    "stream_upsert_shots",
    f"""SELECT {columns(SHOTS)} FROM (
          SELECT * REPLACE (CASE WHEN "left" % 2 = 0 THEN team_score ELSE team_score + 1 END AS team_score) FROM lg_shots)""",
)
def stream_upsert_shots(spark, d):
    """A stream onto a table that two batches have filled, with a third batch in between.

    The batches write their shots with one point more. The stream then brings the shots at even
    places as they are, some of which the table holds and some not, in several micro-batches.
    """
    shots = feeds.shots(events(spark, d)).select(*SHOTS.names)
    earlier = shots.withColumn("team_score", F.col("team_score") + 1)
    even, half = F.col("left") % 2 == 0, F.pmod(F.xxhash64(*SHOTS.keys), F.lit(2)) == 0
    root = scratch_path(spark, "stream-upsert")
    store = KeyedTable(spark, f"{root}/table", SHOTS)
    store.upsert(earlier.where(half), STAMP)
    store.upsert(earlier.where(~half & ~even), STAMP)
    shots.where(even & half).write.mode("append").parquet(f"{root}/arriving")
    stream = live.parquet_stream(spark, f"{root}/arriving", shots.schema)
    live.merge_into(stream, store, STAMP, f"{root}/checkpoint", mode="append").awaitTermination()
    store.upsert(earlier.where(~even & half), STAMP)
    shots.where(even & ~half).write.mode("append").parquet(f"{root}/arriving")
    live.merge_into(stream, store, STAMP, f"{root}/checkpoint", mode="append").awaitTermination()
    return store.read().select(*SHOTS.names)


@query(
    "stream_authorised_requests",
    """SELECT request_id, endpoint, status FROM lg_requests
       WHERE hash IN (SELECT hash FROM lg_keys WHERE NOT revoked AND revoked_at IS NULL)""",
)
def stream_authorised_requests(spark, d):
    checked = cred.authorised(feeds.requests(event_stream(spark, d)), feeds.credentials(spark, d))
    root = scratch_path(spark, "stream-authorised")
    slim = checked.select("request_id", "endpoint", "status")
    live.append_into(slim, f"{root}/rows", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/rows")


@query(
    "stream_late_rows",
    """WITH r AS (SELECT *, row_number() OVER (ORDER BY ts, request_id) * 3 > count(*) OVER () AS early FROM lg_requests),
            w AS (SELECT max(ts) FILTER (early) - INTERVAL 10 MINUTE AS mark FROM r),
            l AS (SELECT *, time_bucket(INTERVAL '1 hour', ts) AS hour,
                         NOT early AND time_bucket(INTERVAL '1 hour', ts) + INTERVAL 1 HOUR <= mark AS late FROM r, w)
       SELECT count(DISTINCT (hour, method, endpoint, status)) FILTER (late) AS dropped, count(*) FILTER (NOT late) AS counted FROM l""",
)
def stream_late_rows(spark, d):
    """The last third of the requests arrives first, then the middle one, then the first, which is late by then.

    Rows count as late against the watermark that the batch before had.
    Late rows are counted where they are dropped, which is after the counts by window and labels have met.
    """
    root = scratch_path(spark, "stream-late")
    requests = feeds.requests(events(spark, d))
    labelled = requests.select("request_id", "ts", *[F.lit("x").alias(c) for c in tm.COUNTER_LABELS])
    ranked = staged(tm.cumulative_requests(labelled, ["ts", "request_id"]).select("request_id", "counter"), "late-ranks")
    third = requests.agg(F.count(F.lit(1))).scalar()
    early = ranked.where(F.col("counter") * 3 > third).select("request_id")
    newest = ranked.where(F.col("counter") * 3 > third * 2).select("request_id")
    store, dropped = KeyedTable(spark, f"{root}/table", live.WINDOWED_COUNTS), 0
    # Each part is one micro-batch of all its files; batches without data would move the watermark between them.
    with session_setting(spark, "spark.sql.streaming.noDataMicroBatches.enabled", "false"):
        for part in (
            requests.join(newest, "request_id", "left_semi"),
            requests.join(early, "request_id", "left_semi").join(newest, "request_id", "left_anti"),
            requests.join(early, "request_id", "left_anti"),
        ):
            part.write.mode("append").parquet(f"{root}/arriving")
            stream = live.parquet_stream(spark, f"{root}/arriving", requests.schema)
            run = live.merge_into(live.live_windows(stream, "1 hour", delay="10 minutes"), store, STAMP, f"{root}/checkpoint")
            run.awaitTermination()
            dropped += live.rows_dropped_as_late(run, spark)
    return store.read().agg(F.sum("n").alias("counted")).select(
        F.lit(dropped).cast("bigint").alias("dropped"), "counted"
    )
