"""Keys judged by time, stored indexes over the stat tables, and late requests set aside."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from courtside.checks import feeds
from courtside.checks.read_queries import LIVE, PLAYOFF, SEASON, TEAM, _page_sql
from courtside.checks.registry import columns, events, query, table
from courtside.checks.write_queries import _CASES, STAMP, _merge_sql, base_and_delta
from courtside.operators import keyvalidity as kv
from courtside.operators.buckettable import BucketTable, buckets_for
from courtside.operators.countcube import CountCube, insert_deltas, signed, visibility_deltas
from courtside.operators.merge import merge_rows
from courtside.operators.nameindex import NameIndex
from courtside.operators.rankindex import open_rank_index, rank_index
from courtside.operators.statquery import StatQuery, matching
from courtside.operators.telemetry import COUNTER_LABELS, SERIES
from courtside.schemas import TOTALS
from courtside.sources.tables import visible
from courtside.streaming.counters import append_increase
from courtside.streaming.keychecks import append_judged
from courtside.streaming.latecounts import LateCounts
from courtside.streaming.live import parquet_stream
from courtside.workspace import scratch_path

# --- keys by time --------------------------------------------------------------------

_SPANS = """SELECT id, hash, begun AS valid_from,
                   CASE WHEN id % 3 = 0 THEN begun + INTERVAL 1 HOUR * (24 * (id % 7 + 1) + id % 24) END AS valid_to
            FROM (SELECT *, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 DAY * (id % 10) AS begun FROM lg_keys)"""
_JUDGED = f"""SELECT request_id, CASE WHEN valid THEN 'authorised' WHEN begun THEN 'revoked' ELSE 'unknown' END AS verdict,
                     CASE WHEN valid THEN id END AS api_key_id
              FROM (SELECT request_id, id, coalesce(valid_from <= ts, FALSE) AS begun,
                           coalesce(valid_from <= ts AND (valid_to IS NULL OR ts < valid_to), FALSE) AS valid
                    FROM lg_requests r LEFT JOIN ({_SPANS}) s ON r.hash = s.hash)"""


def key_changes(spark, d):
    """Keys minted over ten days, each third one revoked within a week; some changes are logged twice."""
    k = F.col("id")
    day, hour = (F.make_dt_interval(**{unit: F.lit(1)}) for unit in ("days", "hours"))
    begun = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + day * F.pmod(k, F.lit(10))
    ended = begun + hour * (24 * (F.pmod(k, F.lit(7)) + 1) + F.pmod(k, F.lit(24)))
    dated = feeds.credentials(spark, d).withColumns(
        {"created_at": begun, "revoked_at": F.when(F.pmod(k, F.lit(3)) == 0, ended)}
    )
    changes = kv.key_changes(dated)
    again = changes.where((F.col("kind") == kv.REVOKE) & (F.pmod(k, F.lit(5)) == 0))
    return changes.unionByName(again.withColumn("at", F.col("at") + day))


@query("judged_requests", _JUDGED)
def judged_requests(spark, d):
    found = kv.judged(feeds.requests(events(spark, d)), key_changes(spark, d))
    return found.select("request_id", "verdict", "api_key_id")


@query("stream_judged_requests", _JUDGED)
def stream_judged_requests(spark, d):
    """Requests and key changes arrive half by half, so that keys are minted and revoked between two
    micro-batches; a last change, of no key, moves the clock past the last request."""
    root = scratch_path(spark, "stream-judged")
    requests, changes = feeds.requests(events(spark, d)), key_changes(spark, d)
    half = F.lit("2024-01-06 00:00:00").cast("timestamp_ntz")
    end = changes.limit(1).select(
        F.lit(-1).cast("bigint").alias("id"), F.lit(None).cast("string").alias("hash"), F.lit(kv.REVOKE).alias("kind"),
        F.lit("2024-03-01 00:00:00").cast("timestamp_ntz").alias("at"),
    )
    parts = [
        (requests.where(F.col("ts") < half), changes.where(F.col("at") < half)),
        (requests.where(F.col("ts") >= half), changes.where(F.col("at") >= half)),
        (requests.limit(0), end),
    ]
    for asked, changed in parts:
        asked.write.mode("append").parquet(f"{root}/requests")
        changed.write.mode("append").parquet(f"{root}/changes")
        streams = [parquet_stream(spark, f"{root}/{name}", rows.schema) for name, rows in (("requests", requests), ("changes", changes))]
        run = append_judged(*streams, ["request_id", "verdict", "api_key_id"], f"{root}/judged", f"{root}/checkpoint", "1 hour")
        run.awaitTermination()
    return spark.read.parquet(f"{root}/judged")


# --- pages by a stored order ---------------------------------------------------------

_INDEXED = {
    "deep": StatQuery(sort_by="assists", page=300, page_size=10),
    "large": StatQuery(sort_by="assists", page=2, page_size=1500),
    "past_end": StatQuery(sort_by="assists", page=10**9),
}
# Small ranges, so that the given tables fill several.
_RANGE_ROWS = 1000


def _indexed_page(q):
    def run(spark, d):
        order, path = q.order(TOTALS), scratch_path(spark, "rank-index")
        rows = matching(table(spark, d, TOTALS), q).select(*TOTALS.names)
        rank_index(rows, order, rows.count(), path, _RANGE_ROWS)
        return open_rank_index(spark, path).page(q.offset, q.page_size)

    return run


for _name, _q in _INDEXED.items():
    query(f"page_rank_index_{_name}", _page_sql(TOTALS, _q, "TRUE"))(_indexed_page(_q))


# --- names by trigrams ---------------------------------------------------------------

_PATTERNS = {
    "trigrams": ("LAYER 4", "player_name ILIKE '%layer 4%'"),
    "one_trigram": ("r 1", "player_name ILIKE '%r 1%'"),
    "short": ("R ", "player_name ILIKE '%r %'"),
    "wildcards_literal": ("r_4%", "contains(lower(player_name), 'r_4%')"),
}


def _by_name(pattern):
    def run(spark, d):
        """The index is built from one half of the table and refreshed with the whole."""
        index, rows = NameIndex(spark, scratch_path(spark, "name-index")), table(spark, d, TOTALS)
        index.refresh(rows.where(F.col("season") < SEASON))
        index.refresh(rows)
        return index.matching(rows, pattern).select(*TOTALS.names)

    return run


for _name, (_pattern, _where) in _PATTERNS.items():
    query(f"filter_name_index_{_name}", f"SELECT {columns(TOTALS)} FROM lg_totals WHERE {LIVE} AND {_where}")(_by_name(_pattern))


# --- totals by a cube ----------------------------------------------------------------

_COVERED = [
    (
        "".join("01"[x] for x in flags),
        StatQuery(season=SEASON if flags[0] else None, team=TEAM if flags[1] else None, is_playoff=PLAYOFF if flags[2] else None),
        " AND ".join(["TRUE"] + [f"season = {SEASON}"] * flags[0] + [f"team = '{TEAM}'"] * flags[1] + ["NOT is_playoff"] * flags[2]),
    )
    for flags in product((False, True), repeat=3)
]


@query(
    "meta_count_cube",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS filters, count(*) AS total FROM lg_totals
            WHERE {LIVE} AND NOT (season = 1996 AND team = '{TEAM}') AND {where}"""
        for name, _, where in _COVERED
    ),
)
def meta_count_cube(spark, d):
    """Two merges and a deletion after the first load, each added as signed deltas; one is sent twice."""
    rows = table(spark, d, TOTALS)
    target = rows.where(F.col("season") < SEASON)
    cube = CountCube(spark, scratch_path(spark, "count-cube"))
    cube.apply("load", signed(visible(target), 1))
    for change, batch in (("first", rows.where(F.col("season").between(SEASON - 1, SEASON))), ("second", rows.where(F.col("season") >= SEASON))):
        batch = visible(batch)
        cube.apply(change, insert_deltas(target, batch, TOTALS))
        cube.apply(change, insert_deltas(target, batch, TOTALS))
        target = merge_rows(target, batch, TOTALS)
    gone = (F.col("season") == 1996) & (F.col("team") == TEAM)
    after = target.withColumn("deleted_at", F.when(gone, F.col("updated_at")).otherwise(F.col("deleted_at")))
    cube.apply("deletion", visibility_deltas(target, after, TOTALS))
    totals = [cube.total(q).select(F.lit(name).alias("filters"), "total") for name, q, _ in _COVERED]
    found = totals[0]
    for more in totals[1:]:
        found = found.unionByName(more)
    return found


# --- merges into bucketed tables -----------------------------------------------------


def _register_bucketed(short):
    spec = _CASES[short][0]

    @query(f"upsert_{short}_bucketed", _merge_sql(short, columns(spec), "deleted_at IS NULL"))
    def upsert(spark, d):
        """Two merges into a bucketed table: the first fills it, the second meets its buckets."""
        _, base, batch = base_and_delta(spark, d, short)
        path = scratch_path(spark, f"bucketed-{short}")
        buckets = buckets_for(base.count() + batch.count())
        store = BucketTable(spark, f"bucketed_{path.rsplit('-', 1)[-1]}", path, spec, buckets)
        store.create()
        store.upsert(visible(base), STAMP)
        store.upsert(batch, STAMP)
        return store.read().select(*spec.names)


for _short in _CASES:
    _register_bucketed(_short)

# --- late requests -------------------------------------------------------------------

_CUTS = ("2024-01-11 00:00:00", "2024-01-21 00:00:00")
_LATE = f"""SELECT *, time_bucket(INTERVAL '1 hour', ts) AS window_start,
                   ts < TIMESTAMP '{_CUTS[1]}' AND time_bucket(INTERVAL '1 hour', ts) + INTERVAL 1 HOUR
                     <= (SELECT max(ts) FROM lg_requests WHERE ts >= TIMESTAMP '{_CUTS[1]}') - INTERVAL 10 MINUTE AS late
            FROM lg_requests"""


def _late_counts(spark, d):
    """The newest requests arrive first, then older ones, which are late by then, each time in several files."""
    counts = LateCounts(spark, scratch_path(spark, "late-counts"))
    requests = feeds.requests(events(spark, d))
    first, second = (F.lit(cut).cast("timestamp_ntz") for cut in _CUTS)
    ts = F.col("ts")
    for part in (ts >= second, (ts >= first) & (ts < second), ts < first):
        requests.where(part).repartition(4, "request_id").write.mode("append").parquet(f"{counts.path}/arriving")
        stream = parquet_stream(spark, f"{counts.path}/arriving", requests.schema)
        counts.run(stream, f"{counts.path}/checkpoint").awaitTermination()
    return counts


@query("stream_late_requests", f"SELECT request_id, ts, endpoint, status FROM ({_LATE}) WHERE late")
def stream_late_requests(spark, d):
    return _late_counts(spark, d).late().select("request_id", "ts", "endpoint", "status")


@query(
    "stream_counts_without_late",
    f"SELECT window_start, {', '.join(COUNTER_LABELS)}, count(*) AS n FROM ({_LATE}) WHERE NOT late GROUP BY ALL",
)
def stream_counts_without_late(spark, d):
    return _late_counts(spark, d).counts()


# --- counters on arriving samples ----------------------------------------------------

_SERIES = ", ".join(SERIES)


@query(
    "stream_counter_increase",
    f"""SELECT {_SERIES}, CAST(sum(CASE WHEN prev IS NULL THEN 0 WHEN value >= prev THEN value - prev ELSE value END) AS BIGINT)
               AS increase
        FROM (SELECT *, lag(value) OVER (PARTITION BY {_SERIES} ORDER BY ts) AS prev FROM lg_samples) GROUP BY ALL""",
)
def stream_counter_increase(spark, d):
    """Samples arrive in three parts; the first edge falls on the counters' restart."""
    root, samples = scratch_path(spark, "stream-increase"), feeds.samples(events(spark, d))
    first, second = (F.lit(f"2024-01-{day} 00:00:00").cast("timestamp_ntz") for day in (15, 22))
    ts = F.col("ts")
    for part in (ts < first, (ts >= first) & (ts < second), ts >= second):
        samples.where(part).write.mode("append").parquet(f"{root}/arriving")
        stream = parquet_stream(spark, f"{root}/arriving", samples.schema)
        append_increase(stream, f"{root}/steps", f"{root}/checkpoint", idle="60 days").awaitTermination()
    return spark.read.parquet(f"{root}/steps").groupBy(*SERIES).agg(F.sum("increase").alias("increase"))
