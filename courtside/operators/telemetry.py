"""Request counters, latency histograms and dashboard reductions."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from courtside.operators.ordered import counter_increase, running_count

COUNTER_LABELS = ["method", "endpoint", "status"]
HISTOGRAM_LABELS = ["method", "endpoint"]
SERIES = ["job", "instance", "method", "endpoint", "status"]
# Length of the stretches of time in which a series' samples are put in order.
STRETCH_S = 3600

# Upper bounds of the latency buckets, in seconds; the last one is +Inf.
BUCKET_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]


def label_filter(**labels: str) -> Column:
    """Equality matchers on labels, all of which must hold."""
    return reduce(and_, [F.col(k) == F.lit(v) for k, v in labels.items()], F.lit(True))


def within(as_of: Column, interval: str, ts: str = "ts") -> Column:
    """Relative range: (as_of - interval, as_of]."""
    return (F.col(ts) > as_of - F.expr(f"INTERVAL {interval}")) & (F.col(ts) <= as_of)


def request_counts(requests: DataFrame) -> DataFrame:
    return requests.groupBy(*COUNTER_LABELS).agg(F.count(F.lit(1)).alias("n"))


def elapsed_seconds(start: str, end: str) -> Column:
    def micros(name: str) -> Column:
        return F.unix_micros(F.col(name).cast("timestamp"))

    return (micros(end) - micros(start)) / F.lit(1e6)


def bucket_counts(duration: str) -> list[Column]:
    """One cumulative count per bound; together they need a single pass."""
    counts = [
        F.count_if(F.col(duration) <= bound).alias(f"le_{i}") for i, bound in enumerate(BUCKET_BOUNDS)
    ]
    return [
        *counts,
        F.count(duration).alias(f"le_{len(BUCKET_BOUNDS)}"),
        F.sum(duration).alias("duration_sum"),
        F.count(duration).alias("duration_count"),
    ]


def latency_histogram_wide(requests: DataFrame, duration: str = "duration_s") -> DataFrame:
    return requests.groupBy(*HISTOGRAM_LABELS).agg(*bucket_counts(duration))


def histogram_rows(wide: DataFrame) -> DataFrame:
    """One row per (labels, le) from the wide form."""
    bounds = [f"{bound:g}" for bound in BUCKET_BOUNDS] + ["+Inf"]
    buckets = F.array(
        *[F.struct(F.lit(le).alias("le"), F.col(f"le_{i}").alias("n")) for i, le in enumerate(bounds)]
    )
    return wide.select(
        *HISTOGRAM_LABELS, F.inline(buckets), "duration_sum", "duration_count"
    )


def latency_histogram(requests: DataFrame, duration: str = "duration_s") -> DataFrame:
    return histogram_rows(latency_histogram_wide(requests, duration))


def succeeded(status: str = "status", error: str = "error") -> Column:
    return F.col(error).isNull() & F.coalesce(F.col(status) == 200, F.lit(False))


def load_summary(results: DataFrame) -> DataFrame:
    """Totals, success and failure counts, and the mean latency of successes.

    The mean divides whole nanoseconds; it is 0 when nothing succeeded.
    """
    ok = succeeded()
    sums = results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(ok).alias("success"),
        F.count_if(~ok).alias("failed"),
        F.sum(F.when(ok, F.col("duration_ns"))).alias("_ns"),
    )
    mean = F.expr("CASE WHEN success > 0 THEN _ns div success ELSE 0 END")
    return sums.withColumn("mean_ns", mean.cast("bigint")).drop("_ns")


def requests_per_second(requests: DataFrame, start: str = "start_ts", end: str = "end_ts") -> DataFrame:
    """All requests over the wall time from the first start to the last end."""
    span = F.unix_micros(F.max(F.col(end)).cast("timestamp")) - F.unix_micros(
        F.min(F.col(start)).cast("timestamp")
    )
    return requests.agg(F.count(F.lit(1)).alias("total"), (span / F.lit(1e6)).alias("wall_s")).select(
        "total", "wall_s", F.try_divide(F.col("total").cast("double"), F.col("wall_s")).alias("rps")
    )


def instant_values(
    samples: DataFrame, step_s: int = 15, lookback_s: int = 300, labels: list[str] | None = None
) -> DataFrame:
    """Value of every series at each step: its newest sample within the look-back.

    A sample serves the steps in [ts, ts + look-back), but only up to the next sample. So one
    sample per (series, first step) is kept, and each becomes just the steps it is the newest for.
    Neighbours are found within stretches of time, so a hot series is spread; where two stretches meet,
    the last aggregate keeps the newer sample.
    """
    labels = labels or SERIES
    step = step_s * 1_000_000
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    first = F.ceil(at / F.lit(step)).cast("bigint")
    last = F.ceil((at + F.lit(lookback_s * 1_000_000)) / F.lit(step)).cast("bigint") - 1
    known = samples.filter(F.col("value").isNotNull()).select(*labels, "ts", "value", first.alias("_first"), last.alias("_last"))
    one = known.groupBy(*labels, "_first").agg(F.max(F.struct("ts", "value", "_last")).alias("_s"))
    stretch = (F.col("_first") * F.lit(step_s) / F.lit(STRETCH_S)).cast("bigint")
    following = F.lead("_first").over(Window.partitionBy(*labels, "_stretch").orderBy("_first"))
    ended = one.withColumn("_stretch", stretch).withColumn(
        "_last", F.least(F.col("_s._last"), F.coalesce(following - 1, F.col("_s._last")))
    )
    steps = F.when(F.col("_first") <= F.col("_last"), F.sequence("_first", "_last")).otherwise(F.array())
    served = ended.select(*labels, "_s", F.explode(steps).alias("_step"))
    newest = served.groupBy("_step", *labels).agg(F.max_by("_s.value", "_s.ts").alias("value"))
    step_ts = F.timestamp_micros(F.col("_step") * F.lit(step)).cast("timestamp_ntz")
    return newest.select(step_ts.alias("step_ts"), *labels, "value")


def last_per_bucket(samples: DataFrame, width: str, labels: list[str] | None = None) -> DataFrame:
    """Newest sample of every series in each time bucket."""
    labels = labels or SERIES
    grouped = samples.groupBy(F.window("ts", width).alias("w"), *labels)
    newest = grouped.agg(F.max_by("value", "ts").alias("value"))
    return newest.select(F.col("w.start").alias("bucket_ts"), *labels, "value")


def sum_by(vector: DataFrame, label: str, ts: str = "step_ts") -> DataFrame:
    """``sum by (label)``: every other label is dropped."""
    return vector.groupBy(ts, label).agg(F.sum("value").alias("value"))


def last_not_null(samples: DataFrame, labels: list[str]) -> DataFrame:
    newest = F.max_by("value", F.when(F.col("value").isNotNull(), F.col("ts")))
    return samples.groupBy(*labels).agg(newest.alias("last_value"))


def sample_count(samples: DataFrame, labels: list[str]) -> DataFrame:
    return samples.groupBy(*labels).agg(F.count("value").alias("samples"))


def absolute_band(value: Column, limit: float = 80) -> Column:
    return F.when(value >= limit, F.lit("red")).otherwise(F.lit("green"))


def percentage_bands(values: DataFrame, column: str = "value") -> DataFrame:
    """Band by position in the min..max range of the whole result: below 20, 80, and above."""
    bounds = values.agg(F.struct(F.min(column).alias("low"), F.max(column).alias("high")).alias("bounds")).scalar()
    low, high = bounds["low"], bounds["high"]
    share = F.coalesce(
        F.try_divide((F.col(column) - low) * F.lit(100.0), (high - low).cast("double")), F.lit(0.0)
    )
    band = F.when(share >= 80, "red").when(share >= 20, "light-blue").otherwise("green")
    return values.withColumn("band", band)


def increase_by_series(samples: DataFrame, labels: list[str] | None = None) -> DataFrame:
    return counter_increase(samples, labels or SERIES)


def cumulative_requests(requests: DataFrame, order: list[str]) -> DataFrame:
    """The counter's value right after each request."""
    return running_count(requests, COUNTER_LABELS, order, "counter")
