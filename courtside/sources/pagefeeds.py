"""Page corpora and the ingest task lists that name which page belongs to what."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from courtside.functions.text import season_page_url, shot_page_url
from courtside.schemas import ADVANCED, TOTALS

# Default season bounds, and the order in which the feeds are listed.
FIRST_SEASON, LAST_SEASON = 1991, 2002
FEED_ORDER = [
    (ADVANCED.name, False),
    (ADVANCED.name, True),
    (TOTALS.name, False),
    (TOTALS.name, True),
]


def ingest_tasks(
    spark: SparkSession, first: int = FIRST_SEASON, last: int = LAST_SEASON
) -> DataFrame:
    """One row per (feed, season): feed order first, then season, bounds inclusive.

    The list is bounded by its arguments (four rows per season), never by data.
    """
    # VALUES has an exact size estimate, so joins to pages broadcast the tasks by themselves.
    values = ", ".join(f"({i}, '{table}', {flag})" for i, (table, flag) in enumerate(FEED_ORDER))
    feeds = spark.sql(f"SELECT * FROM VALUES {values} AS feeds(feed, table_name, is_playoff)")
    tasks = feeds.withColumn("season", F.explode(F.sequence(F.lit(first), F.lit(last))))
    tasks = tasks.withColumn("season", F.col("season").cast("bigint"))
    url = F.when(
        F.col("table_name") == TOTALS.name,
        season_page_url(TOTALS.name, F.col("season"), F.col("is_playoff")),
    ).otherwise(season_page_url(ADVANCED.name, F.col("season"), F.col("is_playoff")))
    position = F.col("feed") * F.lit(last - first + 1) + F.col("season") - F.lit(first)
    return tasks.select(
        position.cast("bigint").alias("task_no"), "table_name", "season", "is_playoff", url.alias("url")
    )


def season_range(players: DataFrame, start: str = "start_season", end: str = "end_season") -> DataFrame:
    """Newest-to-oldest seasons per player, both ends included.

    Rows with a missing argument or ``start < end`` have no valid range and are dropped
    here; :func:`check_season_range` is the strict scalar form.
    """
    valid = (
        (F.col("player_id") != "") & (F.col(start) != 0) & (F.col(end) != 0) & (F.col(start) >= F.col(end))
    )
    return players.filter(valid).withColumn(
        "season", F.explode(F.sequence(F.col(start), F.col(end), F.lit(-1).cast("bigint")))
    )


def check_season_range(player_id: str, start: int, end: int) -> None:
    if not player_id or not start or not end:
        raise ValueError("player_id, start season and end season are required")
    if start < end:
        raise ValueError("start season must not be before end season")


def shot_tasks(players: DataFrame) -> DataFrame:
    """(player_id, season, url) for every season of each player's range."""
    ranged = season_range(players)
    return ranged.select(
        "player_id", "season", shot_page_url(F.col("player_id"), F.col("season")).alias("url")
    )


def pages_of_tasks(pages: DataFrame, tasks: DataFrame) -> DataFrame:
    """Attach the task's season and phase to its pages.

    An equi-join on the address; Spark broadcasts the task side when it is small.
    """
    return pages.join(tasks, "url")
