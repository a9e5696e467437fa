"""Keyed merges, constraint checks, credentials and the joins they imply."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from courtside.checks import feeds
from courtside.checks.registry import columns, customers, events, query, stored_path
from courtside.operators import credentials as cred
from courtside.operators.keyedtable import KeyedTable
from courtside.operators.merge import (
    dealt_keys,
    duplicate_keys,
    last_of_duplicates,
    merge_actions,
    merge_rows,
    null_counts,
    operation_counts,
    split_duplicate_batches,
    with_audit,
)
from courtside.schemas import ADVANCED, AUDIT_COLUMNS, CREDENTIALS, SHOTS, TABLES, TOTALS
from courtside.sources.tables import create_tables, empty_table
from courtside.workspace import scratch_path

STAMP = datetime(2024, 6, 1)
_STAMP_SQL = "TIMESTAMP '2024-06-01 00:00:00'"
_AUDIT = [name for name, _ in AUDIT_COLUMNS]

# Base and delta of each table: the delta changes numbers of known keys and adds new keys.
_CASES = {
    "totals": (TOTALS, "season < 2001", "season >= 2000", ("points", "assists")),
    "advanced": (ADVANCED, "season < 2001", "season >= 2000", ("minutes_played", "games")),
    "shots": (SHOTS, "top % 3 < 2", "top % 3 > 0", ("distance_ft", "team_score")),
}


def _full(spark, d, short):
    """The stored table with its soft-deleted rows."""
    spec = _CASES[short][0]
    rows = spark.read.schema(spec.schema).parquet(stored_path(spark, d, spec))
    return rows.select(*spec.schema.names)


def base_and_delta(spark, d, short):
    spec, base, delta, changed = _CASES[short]
    full = _full(spark, d, short)
    batch = full.filter(delta).select(
        *[(F.col(c) + 1).alias(c) if c in changed else F.col(c) for c in spec.names]
    )
    return spec, full.filter(base), batch


def _merge_sql(short, select, base_rows="TRUE"):
    spec, base, delta, changed = _CASES[short]
    source = f"lg_{short}"
    batch = ", ".join(f'"{c}" + 1 AS "{c}"' if c in changed else f'"{c}"' for c in spec.names)
    on = " AND ".join(f'b."{k}" = n."{k}"' for k in spec.keys)
    first = spec.keys[0]
    pick = [f'coalesce(b."{k}", n."{k}") AS "{k}"' for k in spec.keys]
    pick += [
        f'CASE WHEN n."{first}" IS NOT NULL THEN n."{c}" ELSE b."{c}" END AS "{c}"' for c in spec.updates
    ]
    pick += [
        f'CASE WHEN b."{first}" IS NOT NULL THEN b.{c} ELSE {"NULL" if c == "deleted_at" else _STAMP_SQL} END AS {c}'
        for c in _AUDIT
    ]
    return (
        f"WITH base AS (SELECT * FROM {source} WHERE {base} AND {base_rows}), batch AS (SELECT {batch} FROM {source} WHERE {delta}), "
        f"merged AS (SELECT {', '.join(pick)} FROM base b FULL OUTER JOIN batch n ON {on}) SELECT {select} FROM merged"
    )


def _register_merges(short):
    spec = _CASES[short][0]
    every = ", ".join(f'"{c}"' for c in spec.names + _AUDIT)

    @query(f"upsert_{short}", _merge_sql(short, every))
    def upsert(spark, d):
        _, base, batch = base_and_delta(spark, d, short)
        return merge_rows(base, with_audit(batch, STAMP), spec)

    @query(f"upsert_{short}_small_batch", _merge_sql(short, every))
    def upsert_small(spark, d):
        _, base, batch = base_and_delta(spark, d, short)
        return merge_rows(base, with_audit(batch, STAMP), spec, small_batch=True)

    # The stored base holds visible rows only, so keys deleted there come in as new.
    @query(f"upsert_{short}_stored", _merge_sql(short, columns(spec), "deleted_at IS NULL"))
    def upsert_stored(spark, d):
        """Two commits to a stored table, read back as a user reads it."""
        _, base, batch = base_and_delta(spark, d, short)
        store = KeyedTable(spark, scratch_path(spark, f"upsert-{short}"), spec)
        store.upsert(base.filter(F.col("deleted_at").isNull()), STAMP)
        store.upsert(batch, STAMP)
        return store.read().select(*spec.names)

    _, base_where, delta_where, _ = _CASES[short]

    @query(
        f"db_operations_{short}",
        f"""SELECT CASE WHEN b.known IS NULL THEN 'insert' ELSE 'update' END AS operation,
                   '{spec.name}' AS entity, count(*) AS n
            FROM (SELECT * FROM lg_{short} WHERE {delta_where}) n
            LEFT JOIN (SELECT {", ".join(f'"{k}"' for k in spec.keys)}, TRUE AS known FROM lg_{short} WHERE {base_where}) b
            USING ({", ".join(f'"{k}"' for k in spec.keys)}) GROUP BY 1, 2""",
    )
    def operations(spark, d):
        _, base, batch = base_and_delta(spark, d, short)
        return operation_counts(merge_actions(base, batch, spec), spec.name)


for _short in _CASES:
    _register_merges(_short)


@query(
    "upsert_operation_split",
    """SELECT 'update' AS operation, count(*) AS n FROM lg_totals WHERE season = 2000
       UNION ALL SELECT 'insert', count(*) FROM lg_totals WHERE season >= 2001""",
)
def upsert_operation_split(spark, d):
    spec, base, batch = base_and_delta(spark, d, "totals")
    return merge_actions(base, batch, spec).groupBy("operation").agg(F.count(F.lit(1)).alias("n"))


@query(
    "upsert_empty_batch",
    "SELECT count(*) AS n, CAST(1 AS BIGINT) AS version FROM lg_totals WHERE season < 2001",
)
def upsert_empty_batch(spark, d):
    spec, base, batch = base_and_delta(spark, d, "totals")
    store = KeyedTable(spark, scratch_path(spark, "empty"), spec)
    store.upsert(base, STAMP)
    version = store.upsert(batch.filter("season < 0"), STAMP)
    return store.read_all().agg(F.count(F.lit(1)).alias("n")).withColumn(
        "version", F.lit(version).cast("bigint")
    )


@query(
    "duplicate_keys",
    """SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem
       GROUP BY 1, 2 HAVING count(*) > 1""",
)
def duplicates(spark, d):
    return duplicate_keys(feeds.source(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "unique_keys_audit",
    """SELECT 'player_total_stats' AS table_name, count(*) AS keys, CAST(0 AS BIGINT) AS repeated FROM lg_totals
       UNION ALL SELECT 'player_advanced_stats', count(*), 0 FROM lg_advanced
       UNION ALL SELECT 'player_shot_charts', count(*), 0 FROM lg_shots
       UNION ALL SELECT 'api_keys', count(*), 0 FROM lg_keys""",
)
def unique_keys_audit(spark, d):
    """Natural keys of all four tables: number of keys, and of keys held more than once."""
    keyed = [(spec.name, _full(spark, d, short), list(spec.keys)) for short, (spec, *_) in _CASES.items()]
    keyed.append(("api_keys", feeds.credentials(spark, d), ["hash"]))
    audits = [
        dealt_keys(rows, keys, rows.count()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(
            F.count(F.lit(1)).alias("keys"), F.count_if(F.col("n") > 1).alias("repeated")
        ).select(F.lit(name).alias("table_name"), "keys", "repeated")
        for name, rows, keys in keyed
    ]
    result = audits[0]
    for audit in audits[1:]:
        result = result.unionByName(audit)
    return result


def _last_sql(partition, order, value):
    return (
        f"SELECT {value} FROM (SELECT *, row_number() OVER (PARTITION BY {partition} ORDER BY {order}) AS rn "
        "FROM lineitem) WHERE rn = 1"
    )


@query(
    "last_of_duplicates",
    _last_sql(
        "l_orderkey, l_linenumber",
        "l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC",
        "l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice",
    ),
)
def last_of_duplicate_rows(spark, d):
    line = feeds.source(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"
    )
    return last_of_duplicates(
        line, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]
    )


@query(
    "rejected_duplicate_batches",
    """SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_suppkey NOT IN (
         SELECT l_suppkey FROM lineitem GROUP BY l_suppkey, l_partkey, l_shipdate HAVING count(*) > 1)
       GROUP BY 1""",
)
def rejected_duplicate_batches(spark, d):
    """Batches (here one per supplier) are refused as a whole when a key repeats in them."""
    line = feeds.source(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_shipdate")
    clean, _ = split_duplicate_batches(line, "l_suppkey", ["l_partkey", "l_shipdate"])
    return clean.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query(
    "null_audit",
    """SELECT count(*) FILTER (raw_key IS NULL) AS raw_key, count(*) FILTER (hash IS NULL) AS hash,
              count(*) FILTER (endpoint IS NULL) AS endpoint FROM lg_requests""",
)
def null_audit(spark, d):
    return null_counts(feeds.requests(events(spark, d)), ["raw_key", "hash", "endpoint"])


@query(
    "null_audit_shots",
    "SELECT " + ", ".join(f'count(*) FILTER ("{k}" IS NULL) AS "{k}"' for k in (*SHOTS.keys, "team")) + " FROM lg_shots",
)
def null_audit_shots(spark, d):
    return null_counts(feeds.shots(events(spark, d)), [*SHOTS.keys, "team"])


@query(
    "table_schemas",
    "SELECT 'player_total_stats' AS table_name, count(*) AS stored, CAST(0 AS BIGINT) AS fresh FROM lg_totals "
    "UNION ALL SELECT 'player_advanced_stats', count(*), 0 FROM lg_advanced "
    "UNION ALL SELECT 'player_shot_charts', count(*), 0 FROM lg_shots",
)
def table_schemas(spark, d):
    """Empty tables are created with the declared schemas; the filled ones read under the same."""
    root = scratch_path(spark, "schemas")
    create_tables(spark, root, list(TABLES.values()))
    result = None
    for spec in TABLES.values():
        stored = spark.read.schema(spec.schema).parquet(stored_path(spark, d, spec))
        fresh = spark.read.schema(spec.schema).parquet(f"{root}/{spec.name}")
        counted = stored.agg(F.count(F.lit(1)).alias("stored")).select(
            F.lit(spec.name).alias("table_name"),
            "stored",
            fresh.agg(F.count(F.lit(1)).alias("n")).scalar().alias("fresh"),
        )
        result = counted if result is None else result.unionByName(counted)
    return result


# --- credentials ---------------------------------------------------------------------


@query(
    "mint_credentials",
    f"""SELECT c_custkey AS id, lower(sha256(c_name)) AS hash_hex, c_mktsegment AS label, FALSE AS revoked,
               {_STAMP_SQL} AS created_at FROM customer""",
)
def mint_credentials(spark, d):
    raw = customers(spark, d).select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("raw"), F.col("c_mktsegment").alias("label")
    )
    minted = cred.mint(raw, STAMP)
    return minted.select("id", F.lower(F.hex("hash")).alias("hash_hex"), "label", "revoked", "created_at")


@query(
    "revoke_credentials",
    """SELECT id, label, revoked OR id IN (SELECT s_suppkey FROM supplier) AS revoked FROM lg_keys""",
)
def revoke_credentials(spark, d):
    ids = feeds.source(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    return cred.revoke(feeds.credentials(spark, d), ids).select("id", "label", "revoked")


@query("active_credentials", "SELECT id, hash, label FROM lg_keys WHERE NOT revoked AND revoked_at IS NULL")
def active_credentials(spark, d):
    return cred.active(feeds.credentials(spark, d)).select("id", "hash", "label")


_ACTIVE = "(SELECT hash FROM lg_keys WHERE NOT revoked AND revoked_at IS NULL)"


@query(
    "authorised_requests",
    f"SELECT request_id, endpoint, status, hash FROM lg_requests WHERE hash IN {_ACTIVE}",
)
def authorised_requests(spark, d):
    found = cred.authorised(feeds.requests(events(spark, d)), feeds.credentials(spark, d))
    return found.select("request_id", "endpoint", "status", "hash")


@query(
    "rejected_requests",
    f"SELECT request_id, endpoint, status FROM lg_requests WHERE hash IS NULL OR hash NOT IN {_ACTIVE}",
)
def rejected_requests(spark, d):
    found = cred.rejected(feeds.requests(events(spark, d)), feeds.credentials(spark, d))
    return found.select("request_id", "endpoint", "status")


@query(
    "requests_with_key_id",
    """SELECT r.request_id, r.endpoint, k.id AS api_key_id FROM lg_requests r
       LEFT JOIN (SELECT * FROM lg_keys WHERE NOT revoked AND revoked_at IS NULL) k USING (hash)""",
)
def requests_with_key_id(spark, d):
    found = cred.with_key_id(feeds.requests(events(spark, d)), feeds.credentials(spark, d))
    return found.select("request_id", "endpoint", "api_key_id")


@query(
    "feeds_in_one_table",
    """SELECT is_playoff, count(*) AS n, CAST(sum(points) AS BIGINT) AS points FROM
         (SELECT * FROM lg_totals WHERE is_playoff UNION ALL SELECT * FROM lg_totals WHERE NOT is_playoff)
       GROUP BY 1""",
)
def feeds_in_one_table(spark, d):
    full = _full(spark, d, "totals")
    both = full.filter("is_playoff").unionByName(full.filter("NOT is_playoff"))
    return both.groupBy("is_playoff").agg(F.count(F.lit(1)).alias("n"), F.sum("points").alias("points"))


@query("empty_credentials_schema", "SELECT CAST(0 AS BIGINT) AS fresh, count(*) AS stored FROM lg_keys")
def empty_credentials_schema(spark, d):
    fresh = empty_table(spark, CREDENTIALS).agg(F.count(F.lit(1)).alias("fresh"))
    stored = feeds.credentials(spark, d).agg(F.count(F.lit(1)).alias("n"))
    return fresh.select("fresh", stored.scalar().alias("stored"))
