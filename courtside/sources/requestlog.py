"""Request-result logs as text, and counter samples derived from request logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from courtside.functions.text import duration_ns
from courtside.operators.ordered import running_sum

# The two shapes of a result line; a log prefix may precede them.
DONE_LINE = r"Request ([0-9]+): Status=([0-9]+), Time=(\S+)"
FAILED_LINE = r"Request ([0-9]+) failed(?: to create request)?: (.*)"

SERIES = ["job", "instance", "method", "endpoint", "status"]


def read_request_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_request_lines(spark.read.text(path).withColumnRenamed("value", "line"))


def parse_request_lines(lines: DataFrame) -> DataFrame:
    """``line`` -> request_id, status, duration_ns, error. Works on streams as well."""
    line = F.col("line")
    done, failed = line.rlike(DONE_LINE), line.rlike(FAILED_LINE)
    parsed = lines.filter(done | failed)
    return parsed.select(
        F.when(done, F.regexp_extract(line, DONE_LINE, 1))
        .otherwise(F.regexp_extract(line, FAILED_LINE, 1))
        .cast("bigint")
        .alias("request_id"),
        F.when(done, F.regexp_extract(line, DONE_LINE, 2).cast("bigint")).alias("status"),
        F.when(done, duration_ns(F.regexp_extract(line, DONE_LINE, 3))).alias("duration_ns"),
        F.when(~done, F.regexp_extract(line, FAILED_LINE, 2)).alias("error"),
    )


def counter_samples(requests: DataFrame, interval: str = "15 seconds") -> DataFrame:
    """Cumulative request counters as a scraper would have sampled them.

    Requests are pre-aggregated per series and interval before anything is ordered, so
    a busy series contributes at most one row per interval to the running sum.
    """
    bucketed = requests.groupBy(F.window("ts", interval).alias("w"), *SERIES).agg(
        F.count(F.lit(1)).alias("n")
    )
    flat = bucketed.select(F.col("w.start").alias("ts"), *SERIES, "n")
    return running_sum(flat, SERIES, "ts", "n", "value").select("ts", *SERIES, "value")
