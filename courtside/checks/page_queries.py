"""Page extraction: rendered pages in, typed rows out, compared with what was rendered."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from courtside.checks import feeds
from courtside.checks.registry import columns, customers, query
from courtside.operators.extract import (
    cell_rows,
    comment_bodies,
    extract_shots,
    extract_tables,
    markup_counts,
    shot_rows,
    table_rows,
    typed_rows,
    typed_shots,
)
from courtside.operators.keyedtable import KeyedTable
from courtside.plans.ingest import ingest_pages_into, ingest_shot_pages, ingest_stat_pages, merge_ingested, run_log
from courtside.schemas import ADVANCED, SHOTS, TOTALS
from courtside.sources.pagefeeds import ingest_tasks, pages_of_tasks
from courtside.streaming.live import parquet_stream
from courtside.workspace import scratch_path

STAMP = datetime(2024, 6, 1)


def extracted(spark, d, spec):
    pages = feeds.stat_pages(customers(spark, d), spec)
    tasks = ingest_tasks(spark).filter(F.col("table_name") == spec.name)
    return extract_tables(pages_of_tasks(pages, tasks), spec)


def shot_tasks_of(spark, d):
    return feeds.shot_page_keys(customers(spark, d)).select("url", "player_id", "season")


def extracted_shots(spark, d):
    return extract_shots(pages_of_tasks(feeds.shot_pages(customers(spark, d)), shot_tasks_of(spark, d)))


def _headers(spec, old):
    """All header keys of a page, in order."""

    def key(column):
        keys = spec.page_keys[column]
        older = next((k for k in keys if k in feeds.NEW_NAMES), keys[0]) if len(keys) > 1 else keys[0]
        return older if old or len(keys) == 1 else feeds.NEW_NAMES[older]

    return ",".join(key(c) for c in spec.names if c in spec.page_keys)


for _spec, _short in ((TOTALS, "totals"), (ADVANCED, "advanced")):
    query(f"extract_{_short}_rows", f"SELECT page_id, {columns(_spec)} FROM lg_{_short}_rows")(
        lambda spark, d, spec=_spec: typed_rows(table_rows(extracted(spark, d, spec), spec), spec)
    )
    query(
        f"extract_{_short}_page_status",
        """SELECT season, is_playoff, CASE WHEN v IN (7, 8) THEN 'no_table' ELSE 'ok' END AS status, count(*) AS n
           FROM lg_page_keys GROUP BY 1, 2, 3""",
    )(
        lambda spark, d, spec=_spec: extracted(spark, d, spec)
        .groupBy("season", "is_playoff", "status")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    query(
        f"extract_{_short}_row_kinds",
        f"""SELECT kind, count(*) AS n FROM (
              SELECT CASE WHEN v = 9 AND i = 1 THEN 'malformed' ELSE 'player' END AS kind FROM lg_page_rows
              WHERE {"i <> 4" if _spec is TOTALS else "TRUE"}
              UNION ALL SELECT 'no_player' FROM lg_page_keys WHERE v NOT IN (7, 8)) GROUP BY 1""",
    )(
        lambda spark, d, spec=_spec: table_rows(extracted(spark, d, spec), spec)
        .groupBy("kind")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    query(
        f"extract_{_short}_headers",
        f"""SELECT p AS page_id, CASE WHEN v = 5 THEN '{_headers(_spec, True)}' ELSE '{_headers(_spec, False)}' END
                   || CASE WHEN v = 6 THEN ',pos' ELSE '' END AS head,
                   {len(_spec.page_keys)} + CASE WHEN v = 6 THEN 1 ELSE 0 END AS n FROM lg_page_keys WHERE v NOT IN (7, 8)""",
    )(
        lambda spark, d, spec=_spec: extracted(spark, d, spec)
        .filter(F.col("status") == "ok")
        .select(
            "page_id",
            F.array_join("headers", ",").alias("head"),
            F.size("headers").alias("n"),
        )
    )


@query(
    "extract_long_cells",
    """SELECT data_stat, count(*) AS n, count(append_csv) AS with_player FROM (
         SELECT CASE WHEN v = 5 THEN 'player' ELSE 'name_display' END AS data_stat, p AS append_csv FROM lg_page_rows
         UNION ALL SELECT 'pos', NULL FROM lg_page_rows
         UNION ALL SELECT 'pos', NULL FROM lg_page_rows WHERE v = 6
         UNION ALL SELECT 'age', NULL FROM lg_page_rows
         UNION ALL SELECT CASE WHEN v = 5 THEN 'player' ELSE 'name_display' END, NULL FROM lg_page_keys WHERE v NOT IN (7, 8)
         UNION ALL SELECT CASE WHEN v = 5 THEN 'player' ELSE 'name_display' END, NULL FROM lg_page_rows WHERE i = 2)
       GROUP BY 1""",
)
def extract_long_cells(spark, d):
    """Long view: name, position and age cells of all body rows, repeated headers included."""
    cells = cell_rows(extracted(spark, d, TOTALS))
    wanted = cells.filter(F.col("data_stat").isin("player", "name_display", "pos", "age"))
    return wanted.groupBy("data_stat").agg(
        F.count(F.lit(1)).alias("n"), F.count("append_csv").alias("with_player")
    )


@query(
    "extract_row_players",
    """SELECT p AS page_id, CAST(count(*) AS BIGINT) AS players, max('x' || p || '-' || i) AS last_player
       FROM lg_page_rows WHERE NOT (v = 9 AND i = 1) AND i <> 4 GROUP BY p""",
)
def extract_row_players(spark, d):
    rows = table_rows(extracted(spark, d, TOTALS), TOTALS).filter(F.col("kind") == "player")
    return rows.groupBy("page_id").agg(
        F.count("player_id").alias("players"), F.max("player_id").alias("last_player")
    )


@query("extract_shot_rows", f"SELECT page_id, {columns(SHOTS)} FROM lg_shot_rows")
def extract_shot_rows(spark, d):
    return typed_shots(shot_rows(extracted_shots(spark, d)))


@query(
    "extract_shot_page_status",
    """SELECT CASE v WHEN 3 THEN 'no_comment' WHEN 4 THEN 'no_wrapper' WHEN 6 THEN 'http_error' ELSE 'ok' END AS status,
              count(*) AS n FROM lg_shot_keys GROUP BY 1""",
)
def extract_shot_page_status(spark, d):
    return extracted_shots(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "extract_shot_points",
    """SELECT kind, count(*) AS n FROM (SELECT CASE WHEN v = 7 AND i = 2 THEN 'malformed' ELSE 'shot' END AS kind
       FROM lg_shot_points) GROUP BY 1""",
)
def extract_shot_points(spark, d):
    return shot_rows(extracted_shots(spark, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "extract_player_names",
    """SELECT p AS page_id, CASE WHEN v = 5 THEN player_id ELSE 'Shooter ' || p END AS player_name
       FROM lg_shot_keys WHERE v NOT IN (3, 4, 6)""",
)
def extract_player_names(spark, d):
    found = extracted_shots(spark, d).filter(F.col("status") == "ok")
    return found.select("page_id", "player_name")


@query(
    "page_comments",
    """SELECT page_id, len(c) AS comments, md5(array_to_string(c, '|')) AS bodies FROM (
         SELECT page_id, regexp_extract_all(html, '(?s)<!--(.*?)-->', 1) AS c FROM pages)""",
)
def page_comments(spark, d):
    """Comment texts of the raw pages, whole pages, natively."""
    found = feeds.source(spark, d, "pages").select("page_id", comment_bodies(F.col("html")).alias("c"))
    return found.select(
        "page_id", F.size("c").cast("bigint").alias("comments"), F.md5(F.array_join("c", "|")).alias("bodies")
    )


@query(
    "raw_page_elements",
    r"""SELECT page_id, 'ok' AS status, len(regexp_extract_all(html, '(?s)<!--.*?-->')) AS comments,
               len(regexp_extract_all(live, '<p[\s>]')) AS n_p, len(regexp_extract_all(live, '<li[\s>]')) AS n_li,
               len(regexp_extract_all(live, '<a[\s>]')) AS n_a
        FROM (SELECT page_id, html,
                     regexp_replace(regexp_replace(html, '(?s)<(script|style|title)[\s>].*?</(script|style|title)>', '', 'g'),
                                    '(?s)<!--.*?-->', '', 'g') AS live FROM pages)""",
)
def raw_page_elements(spark, d):
    """The markup reader over every raw page: comments and elements it finds."""
    return markup_counts(feeds.source(spark, d, "pages"), ["p", "li", "a"])


@query("raw_page_status", "SELECT page_id, 'no_table' AS status FROM pages")
def raw_page_status(spark, d):
    """Raw pages hold no statistics table; each one is reported, none stops the job."""
    pages = feeds.source(spark, d, "pages").select(
        "page_id", "html", F.lit(1998).cast("bigint").alias("season"), F.lit(False).alias("is_playoff")
    )
    return extract_tables(pages, TOTALS).select("page_id", "status")


@query(
    "page_task_join",
    """SELECT season, is_playoff, count(*) AS pages FROM lg_page_keys GROUP BY 1, 2""",
)
def page_task_join(spark, d):
    pages = feeds.stat_pages(customers(spark, d), TOTALS)
    tasks = ingest_tasks(spark).filter(F.col("table_name") == TOTALS.name)
    return pages_of_tasks(pages, tasks).groupBy("season", "is_playoff").agg(F.count(F.lit(1)).alias("pages"))


for _spec, _short in ((TOTALS, "totals"), (ADVANCED, "advanced")):

    def _ingest(spark, d, spec=_spec):
        """Whole ingest: tasks, pages, extraction, cleaning, merge, read back."""
        ingested = ingest_stat_pages(feeds.stat_pages(customers(spark, d), spec), ingest_tasks(spark), spec)
        store = KeyedTable(spark, scratch_path(spark, f"ingest-{spec.name}"), spec)
        merge_ingested(store, ingested, STAMP)
        return store.read().select(*spec.names)

    query(f"ingest_{_short}", f"SELECT {columns(_spec)} FROM lg_{_short}_rows")(_ingest)


@query("stream_ingest_totals", f"SELECT {columns(TOTALS)} FROM lg_totals_rows")
def stream_ingest_totals(spark, d):
    """Pages that keep arriving: extraction and merge in every micro-batch."""
    root = scratch_path(spark, "stream-ingest")
    pages = feeds.stat_pages(customers(spark, d), TOTALS)
    store = KeyedTable(spark, f"{root}/table", TOTALS)
    # Two arrivals, each a micro-batch of all its files; between pages with a key in common the later one wins.
    for part in (pages.filter("page_id < 60"), pages.filter("page_id >= 60")):
        part.write.mode("append").parquet(f"{root}/pages")
        stream = parquet_stream(spark, f"{root}/pages", pages.schema)
        ingest_pages_into(stream, ingest_tasks(spark), store, STAMP, f"{root}/checkpoint").awaitTermination()
    return store.read().select(*TOTALS.names)


@query("ingest_shots", f"SELECT {columns(SHOTS)} FROM lg_shot_rows")
def ingest_shots(spark, d):
    ingested = ingest_shot_pages(feeds.shot_pages(customers(spark, d)), shot_tasks_of(spark, d))
    store = KeyedTable(spark, scratch_path(spark, "ingest-shots"), SHOTS)
    merge_ingested(store, ingested, STAMP)
    return store.read().select(*SHOTS.names)


@query(
    "ingest_run_log",
    """SELECT 'player_total_stats' AS table_name, season, is_playoff, status, count(*) AS pages,
              CAST(sum(n) AS BIGINT) AS n_rows
       FROM (SELECT k.season, k.is_playoff, coalesce(r.n, 0) AS n,
                    CASE WHEN v IN (7, 8) THEN 'no_table' WHEN r.n IS NULL THEN 'empty' ELSE 'ok' END AS status
             FROM lg_page_keys k LEFT JOIN (SELECT page_id, count(*) AS n FROM lg_totals_rows GROUP BY 1) r
               ON r.page_id = k.p) GROUP BY 1, 2, 3, 4""",
)
def ingest_run_log(spark, d):
    ingested = ingest_stat_pages(feeds.stat_pages(customers(spark, d), TOTALS), ingest_tasks(spark), TOTALS)
    return run_log(ingested, TOTALS)
