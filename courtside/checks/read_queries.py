"""Scans, projections, filters, sorts and pages."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F, types as T

from courtside.checks.registry import columns, customers, events, query, response_columns, table
from courtside.checks import feeds
from courtside.operators.paging import (
    JSON_OPTIONS,
    credential_json,
    json_rows,
    page_after,
    page_envelope,
    page_meta,
    page_rows,
    page_with_meta,
)
from courtside.operators.statquery import StatQuery, matching, response_rows
from courtside.schemas import ADVANCED, AUDIT_COLUMNS, SHOTS, TOTALS
from courtside.sources.pagefeeds import ingest_tasks, season_range, shot_tasks
from courtside.sources.requestlog import counter_samples, parse_request_lines, read_request_log
from courtside.sources.tables import listed_credentials
from courtside.streaming.live import append_into
from courtside.workspace import scratch_path

LIVE = "deleted_at IS NULL"

# A season, team, player and phase that every data scale holds.
SEASON, TEAM, PLAYER, PLAYOFF = 1998, "T07", "p0000000042", False

# --- scans and sources ---------------------------------------------------------------

for _name, _spec in (("totals", TOTALS), ("advanced", ADVANCED), ("shots", SHOTS)):
    query(f"scan_{_name}", f"SELECT {columns(_spec)}, created_at, updated_at, deleted_at FROM lg_{_name} WHERE {LIVE}")(
        lambda spark, d, spec=_spec: table(spark, d, spec)
    )
    query(f"project_{_name}_response", f"SELECT {response_columns(_spec)} FROM lg_{_name} WHERE {LIVE}")(
        lambda spark, d, spec=_spec: response_rows(table(spark, d, spec), spec)
    )


@query(
    "scan_credentials",
    """SELECT id, base64(unhex(hash)) AS hash, label, revoked, created_at, revoked_at
       FROM lg_keys WHERE revoked_at IS NULL""",
)
def scan_credentials(spark, d):
    keys = feeds.credentials(spark, d).withColumn("hash", F.unhex("hash"))
    return listed_credentials(keys)


for _name, _spec in (("totals", TOTALS), ("advanced", ADVANCED)):
    query(
        f"page_urls_{_name}",
        f"""SELECT p AS page_id, 'https://www.basketball-reference.com/' ||
                   CASE WHEN is_playoff THEN 'playoffs' ELSE 'leagues' END || '/NBA_' || season || '_{_name}.html' AS url
            FROM lg_page_keys""",
    )(lambda spark, d, spec=_spec: feeds.stat_page_keys(customers(spark, d), spec).select("page_id", "url"))


@query(
    "page_urls_shots",
    """SELECT player_id, season, 'https://www.basketball-reference.com/players/' || substr(player_id, 1, 1) || '/' ||
              player_id || '/shooting/' || season AS url
       FROM (SELECT DISTINCT player_id, unnest(range(hi, lo - 1, -1)) AS season
             FROM (SELECT player_id, min(season) AS lo, max(season) AS hi FROM lg_totals GROUP BY 1))""",
)
def page_urls_shots(spark, d):
    return shot_tasks(_player_ranges(spark, d))


def _player_ranges(spark, d):
    return feeds.totals(spark, d).groupBy("player_id").agg(
        F.max("season").alias("start_season"), F.min("season").alias("end_season")
    )


@query(
    "season_ranges_descending",
    """SELECT player_id, hi AS start_season, lo AS end_season, unnest(range(hi, lo - 1, -1)) AS season
       FROM (SELECT player_id, min(season) AS lo, max(season) AS hi FROM lg_totals GROUP BY 1)""",
)
def season_ranges_descending(spark, d):
    return season_range(_player_ranges(spark, d))


@query(
    "ingest_task_pages",
    """SELECT f.feed * 12 + s - 1991 AS task_no, f.table_name, CAST(s AS BIGINT) AS season, f.is_playoff,
              count(k.p) AS pages
       FROM (VALUES (0, 'player_advanced_stats', FALSE), (1, 'player_advanced_stats', TRUE),
                    (2, 'player_total_stats', FALSE), (3, 'player_total_stats', TRUE)) f(feed, table_name, is_playoff)
       CROSS JOIN (SELECT unnest(range(1991, 2003)) AS s)
       LEFT JOIN lg_page_keys k ON k.season = s AND k.is_playoff = f.is_playoff
       GROUP BY ALL""",
)
def ingest_task_pages(spark, d):
    """The ingest task list with the number of pages each task finds."""
    urls = [feeds.stat_page_keys(customers(spark, d), spec).select("url") for spec in (TOTALS, ADVANCED)]
    found = urls[0].unionByName(urls[1]).groupBy("url").agg(F.count(F.lit(1)).alias("n"))
    return ingest_tasks(spark).join(found, "url", "left").select(
        "task_no", "table_name", "season", "is_playoff", F.coalesce("n", F.lit(0)).alias("pages")
    )


@query("request_log_lines", "SELECT request_id, status, duration_ns, error FROM lg_loadlog")
def request_log_lines(spark, d):
    return parse_request_lines(feeds.load_lines(events(spark, d)))


def _log_folder(spark, d):
    """The log as text files, as a load test leaves it."""
    path = scratch_path(spark, "request-log")
    feeds.load_lines(events(spark, d)).write.text(path)
    return path


@query("request_log_files", "SELECT request_id, status, duration_ns, error FROM lg_loadlog")
def request_log_files(spark, d):
    return read_request_log(spark, _log_folder(spark, d))


@query("stream_request_log", "SELECT request_id, status, duration_ns, error FROM lg_loadlog")
def stream_request_log(spark, d):
    root = scratch_path(spark, "stream-log")
    lines = spark.readStream.text(_log_folder(spark, d)).withColumnRenamed("value", "line")
    append_into(parse_request_lines(lines), f"{root}/rows", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/rows")


@query(
    "counter_samples_15s",
    """SELECT ts, job, instance, method, endpoint, status,
              CAST(sum(n) OVER (PARTITION BY job, instance, method, endpoint, status ORDER BY ts) AS BIGINT) AS value
       FROM (SELECT time_bucket(INTERVAL '15 seconds', ts) AS ts, job, instance, method, endpoint, status,
                    count(*) AS n
             FROM lg_requests GROUP BY 1, 2, 3, 4, 5, 6)""",
)
def counter_samples_15s(spark, d):
    return counter_samples(feeds.requests(events(spark, d)))


# --- filters -------------------------------------------------------------------------

_FILTERS = {
    "season": (StatQuery(season=SEASON), f"season = {SEASON}"),
    "team": (StatQuery(team=TEAM), f"team = '{TEAM}'"),
    "player": (StatQuery(player_id=PLAYER), f"player_id = '{PLAYER}'"),
    "player_alias": (StatQuery.from_params({"player_id": PLAYER}), f"player_id = '{PLAYER}'"),
    "phase_any": (StatQuery.from_params({"isPlayoff": ""}), "TRUE"),
    "phase_playoff": (StatQuery.from_params({"isPlayoff": "true"}), "is_playoff"),
    "phase_regular": (StatQuery.from_params({"isPlayoff": "no"}), "NOT is_playoff"),
    "bad_numbers": (StatQuery.from_params({"season": "19x8", "page": "-", "pageSize": ""}), "TRUE"),
    "player_name": (StatQuery(player_name="Player 42"), "player_name = 'Player 42'"),
    "name_contains": (StatQuery(name_contains="LAYER 4"), "player_name ILIKE '%layer 4%'"),
    "name_wildcards_literal": (StatQuery(name_contains="r_4%"), "contains(lower(player_name), 'r_4%')"),
}

for _name, (_query, _where) in _FILTERS.items():
    query(
        f"filter_{_name}",
        f"SELECT {columns(TOTALS)} FROM lg_totals WHERE {LIVE} AND {_where}",
    )(lambda spark, d, q=_query: matching(table(spark, d, TOTALS), q).select(*TOTALS.names))


def _combinations():
    flags = list(product((False, True), repeat=4))
    for flag in flags:
        s, t, p, f = flag
        yield (
            "".join("01"[x] for x in flag),
            StatQuery(
                season=SEASON if s else None, team=TEAM if t else None,
                player_id=PLAYER if p else None, is_playoff=PLAYOFF if f else None,
            ),
            " AND ".join(
                [LIVE]
                + [f"season = {SEASON}"] * s + [f"team = '{TEAM}'"] * t
                + [f"player_id = '{PLAYER}'"] * p + ["NOT is_playoff"] * f
            ),
        )


def _combination_counts(spec):
    def run(spark, d):
        """Every subset of the four filters, counted in one pass."""
        cases = [(name, q.predicate()) for name, q, _ in _combinations()]
        counts = table(spark, d, spec).agg(*[F.count_if(p).alias(f"c{name}") for name, p in cases])
        rows = F.array(*[F.struct(F.lit(name).alias("filters"), F.col(f"c{name}").alias("n")) for name, _ in cases])
        return counts.select(F.inline(rows))

    return run


for _spec in (TOTALS, ADVANCED):
    _short = "totals" if _spec is TOTALS else "advanced"
    query(
        f"filter_combinations_{_short}",
        " UNION ALL ".join(
            f"SELECT '{name}' AS filters, count(*) AS n FROM lg_{_short} WHERE {where}"
            for name, _, where in _combinations()
        ),
    )(_combination_counts(_spec))

_SHOT_FILTERS = {
    "none": ({}, "TRUE"),
    "player": ({"playerId": PLAYER}, f"player_id = '{PLAYER}'"),
    "season": ({"season": "2024"}, "season = 2024"),
    "both": ({"playerId": PLAYER, "season": "2024"}, f"player_id = '{PLAYER}' AND season = 2024"),
    "alias_ignored": ({"player_id": PLAYER}, "TRUE"),
}

for _name, (_params, _where) in _SHOT_FILTERS.items():
    query(
        f"shots_filter_{_name}",
        f"SELECT {response_columns(SHOTS)} FROM lg_shots WHERE {LIVE} AND {_where}",
    )(
        lambda spark, d, params=_params: response_rows(
            matching(table(spark, d, SHOTS), StatQuery.from_params(params, aliases=False)), SHOTS
        )
    )


@query(
    "filter_soft_deleted",
    "SELECT count(*) AS stored, count(*) FILTER (deleted_at IS NULL) AS visible FROM lg_totals",
)
def filter_soft_deleted(spark, d):
    stored = feeds.totals(spark, d).agg(F.count(F.lit(1)).alias("stored"))
    return stored.select(
        "stored",
        matching(feeds.totals(spark, d), StatQuery()).agg(F.count(F.lit(1)).alias("n")).scalar().alias("visible"),
    )


# --- sorts and pages -----------------------------------------------------------------


def _order_sql(spec, q):
    return ", ".join(f'"{c}" {"DESC" if down else "ASC"} NULLS LAST' for c, down in q.order(spec))


def _page_sql(spec, q, where):
    short = "totals" if spec is TOTALS else "advanced"
    return (
        f"SELECT {columns(spec)} FROM lg_{short} WHERE {LIVE} AND {where} "
        f"ORDER BY {_order_sql(spec, q)} LIMIT {q.page_size} OFFSET {q.offset}"
    )


def _register_page(name, spec, q, where="TRUE"):
    query(name, _page_sql(spec, q, where))(
        lambda spark, d: page_rows(table(spark, d, spec), spec, q).select(*spec.names)
    )


for _spec, _short in ((TOTALS, "totals"), (ADVANCED, "advanced")):
    for _key in _spec.sort_keys:
        _register_page(f"sort_{_short}_by_{_key}", _spec, StatQuery(sort_by=_spec.response_names[_key]))
    for _key in _spec.extended_sort_keys:
        _register_page(
            f"sort_{_short}_by_{_key}_extended", _spec,
            StatQuery(sort_by=_spec.response_names[_key], extended=True),
        )
    _register_page(f"sort_{_short}_unknown_key", _spec, StatQuery(sort_by="points; drop table x"))
    _register_page(
        f"sort_{_short}_ascending", _spec, StatQuery.from_params({"ascending": "true", "sortBy": "season"})
    )
    _register_page(
        f"page_{_short}_first", _spec, StatQuery(season=SEASON, is_playoff=False),
        f"season = {SEASON} AND NOT is_playoff",
    )
    _register_page(
        f"page_{_short}_third", _spec, StatQuery(season=SEASON, is_playoff=False, page=3),
        f"season = {SEASON} AND NOT is_playoff",
    )
    _register_page(f"page_{_short}_past_end", _spec, StatQuery(page=10**9, team=TEAM), f"team = '{TEAM}'")
    _register_page(f"page_{_short}_below_one", _spec, StatQuery(page=-4))

DEEP = StatQuery(page=120, page_size=150)


@query("page_totals_deep", _page_sql(TOTALS, DEEP, "TRUE"))
def page_totals_deep(spark, d):
    """A deep page located by narrowing the sort range instead of keeping a long prefix."""
    return page_rows(table(spark, d, TOTALS), TOTALS, DEEP, heap_rows=2000).select(*TOTALS.names)


LARGE = StatQuery(page=2, page_size=9000)


@query("page_totals_large", _page_sql(TOTALS, LARGE, "TRUE"))
def page_totals_large(spark, d):
    """A page larger than one heap: its rows are numbered stretch by stretch, in parallel."""
    return page_rows(table(spark, d, TOTALS), TOTALS, LARGE, heap_rows=2000).select(*TOTALS.names)


@query(
    "page_with_total_past_end",
    f"""SELECT {", ".join(f'NULL::{k} AS "{c}"' for c, k in (("player_id", "VARCHAR"), ("season", "BIGINT")))},
               count(*) AS total, (count(*) + 19) // 20 AS pages FROM lg_totals WHERE {LIVE} AND team = '{TEAM}'""",
)
def page_with_total_past_end(spark, d):
    q = StatQuery(team=TEAM, page=10**6)
    return page_with_meta(table(spark, d, TOTALS), TOTALS, q).select("player_id", "season", "total", "pages")


@query("page_totals_after_boundary", _page_sql(TOTALS, StatQuery(page=2), "TRUE"))
def page_totals_after_boundary(spark, d):
    """Keyset paging: the second page, asked for by the last row of the first."""
    rows, q = table(spark, d, TOTALS), StatQuery()
    names = [c for c, _ in q.order(TOTALS)]
    last = page_rows(rows, TOTALS, q).select(*names).collect()[-1]
    return page_after(rows, TOTALS, q, tuple(last)).select(*TOTALS.names)


def _meta_sql(short, q, where):
    return (
        f'SELECT count(*) AS total, CAST({q.page} AS BIGINT) AS page, CAST({q.page_size} AS BIGINT) AS "pageSize", '
        f"(count(*) + {q.page_size} - 1) // {q.page_size} AS pages FROM lg_{short} WHERE {LIVE} AND {where}"
    )


for _spec, _short in ((TOTALS, "totals"), (ADVANCED, "advanced")):
    _q = StatQuery(season=SEASON, page=2)
    query(f"meta_{_short}", _meta_sql(_short, _q, f"season = {SEASON}"))(
        lambda spark, d, spec=_spec, q=_q: page_meta(table(spark, d, spec), q)
    )
    query(f"meta_{_short}_past_end", _meta_sql(_short, StatQuery(page=10**6), "TRUE"))(
        lambda spark, d, spec=_spec: page_meta(table(spark, d, spec), StatQuery(page=10**6))
    )


@query(
    "page_with_total",
    f"""SELECT {columns(TOTALS)}, (SELECT count(*) FROM lg_totals WHERE {LIVE} AND team = '{TEAM}') AS total,
               (SELECT (count(*) + 19) // 20 FROM lg_totals WHERE {LIVE} AND team = '{TEAM}') AS pages
        FROM lg_totals WHERE {LIVE} AND team = '{TEAM}'
        ORDER BY {_order_sql(TOTALS, StatQuery())} LIMIT 20""",
)
def page_with_total(spark, d):
    q = StatQuery(team=TEAM)
    return page_with_meta(table(spark, d, TOTALS), TOTALS, q).select(*TOTALS.names, "total", "pages")


_AUDIT_SQL = ", ".join(f'{c} AS "{r}"' for c, r in AUDIT_COLUMNS)


def _response_type(spec):
    """Every field of a response row, as it is parsed back from JSON."""
    fields_ = [T.StructField(spec.response_names[c], kind) for c, kind in spec.types.items()]
    return T.StructType(fields_ + [T.StructField(r, T.TimestampNTZType()) for _, r in AUDIT_COLUMNS])


def _register_envelope(spec, short):
    @query(
        f"envelope_{short}",
        f"""WITH hit AS (SELECT *, row_number() OVER (ORDER BY {_order_sql(spec, StatQuery())}) AS pos
                         FROM lg_{short} WHERE {LIVE} AND season = {SEASON})
            SELECT CAST(pos AS INTEGER) AS pos, {response_columns(spec)}, {_AUDIT_SQL},
                   (SELECT count(*) FROM hit) AS total, CAST(2 AS BIGINT) AS page, CAST(20 AS BIGINT) AS "pageSize",
                   (SELECT (count(*) + 19) // 20 FROM hit) AS pages
            FROM hit WHERE pos BETWEEN 21 AND 40""",
    )
    def envelope(spark, d):
        """The JSON document, read back: row order, every field of a row and the paging numbers."""
        document = page_envelope(table(spark, d, spec), spec, StatQuery(season=SEASON, page=2))
        paging = T.StructType([T.StructField(n, T.LongType()) for n in ("total", "page", "pageSize", "pages")])
        shape = T.StructType(
            [T.StructField("data", T.ArrayType(_response_type(spec))), T.StructField("pagination", paging)]
        )
        parsed = document.select(F.from_json("envelope", shape, JSON_OPTIONS).alias("e"))
        return parsed.select("e.pagination.*", F.posexplode("e.data").alias("pos", "row")).select(
            (F.col("pos") + 21).alias("pos"), "row.*", "total", "page", "pageSize", "pages"
        )


_register_envelope(TOTALS, "totals")
_register_envelope(ADVANCED, "advanced")


@query("envelope_empty_page", f"""SELECT 0 AS n_rows, (SELECT count(*) FROM lg_totals WHERE {LIVE}) AS total""")
def envelope_empty_page(spark, d):
    document = page_envelope(table(spark, d, TOTALS), TOTALS, StatQuery(page=10**6))
    return document.select(
        F.json_array_length(F.get_json_object("envelope", "$.data")).alias("n_rows"),
        F.get_json_object("envelope", "$.pagination.total").cast("bigint").alias("total"),
    )


@query("json_rows_shots", f"SELECT {response_columns(SHOTS)}, {_AUDIT_SQL} FROM lg_shots WHERE {LIVE}")
def json_rows_shots(spark, d):
    """Unpaged JSON rows, every field parsed again."""
    rows = json_rows(table(spark, d, SHOTS), SHOTS)
    return rows.select(F.from_json("json", _response_type(SHOTS), JSON_OPTIONS).alias("r")).select("r.*")


@query(
    "json_rows_credentials",
    """SELECT id AS "ID", base64(unhex(hash)) AS "Hash", label AS "Label", revoked AS "Revoked",
              created_at AS "CreatedAt", revoked_at AS "RevokedAt" FROM lg_keys WHERE revoked_at IS NULL""",
)
def json_rows_credentials(spark, d):
    keys = feeds.credentials(spark, d).withColumn("hash", F.unhex("hash"))
    shape = "ID bigint, Hash string, Label string, Revoked boolean, CreatedAt timestamp_ntz, RevokedAt timestamp_ntz"
    return credential_json(keys).select(F.from_json("json", shape, JSON_OPTIONS).alias("r")).select("r.*")
