"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtside.checks import feeds
from courtside.checks.registry import customers, events, query
from courtside.functions import (
    duration_ns,
    fields,
    first_nonempty,
    first_nonzero,
    has_class_token,
    key_hash,
    lookup,
    pixels,
    strict_float,
    strict_int,
    trim_space,
    zip_last_wins,
)
from courtside.operators.extract import shot_date
from courtside.operators.telemetry import elapsed_seconds

_WS_SQL = r"[\t\n\v\f\r \x{85}\p{Z}]"

# One spelling of a quantity per line number: {n} is the whole number as text.
_INT_SHAPES = ["{n}", "+{n}", " {n}", "{n}abc", "99999999999999999999{n}", "-{n}", "{n}\n", "-99999999999999999999{n}"]
_FLOAT_SHAPES = [".{n}", "{n}.", "{n}e2", "-{n}.5", "{n}d", "1_{n}", "NaN", "+{n}E-1"]


def _shaped(shapes):
    """Text column: shape chosen by line number and supplier, filled with the quantity."""
    pick = F.pmod(F.col("l_linenumber") + F.col("l_suppkey"), F.lit(len(shapes)))
    number = F.col("l_quantity").cast("bigint").cast("string")
    text = F.lit("")
    for i, shape in reversed(list(enumerate(shapes))):
        before, found, after = shape.partition("{n}")
        filled = F.concat(F.lit(before), number, F.lit(after)) if found else F.lit(shape)
        text = F.when(pick == i, filled).otherwise(text)
    return text


def _shaped_sql(shapes):
    whens = []
    for i, shape in enumerate(shapes):
        before, found, after = shape.partition("{n}")
        after = after.replace("\n", "' || chr(10) || '")
        filled = f"'{before}' || q || '{after}'" if found else f"'{shape}'"
        whens.append(f"WHEN {i} THEN {filled}")
    return (
        f"SELECT CASE (l_linenumber + l_suppkey) % {len(shapes)} {' '.join(whens)} END AS text "
        "FROM (SELECT *, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS q FROM lineitem)"
    )


@query(
    "strict_int",
    f"""SELECT text, CASE WHEN NOT regexp_full_match(text, '[+-]?[0-9]+') THEN 0
                  WHEN h > 9223372036854775807 THEN 9223372036854775807
                  WHEN h < -9223372036854775808 THEN -9223372036854775808 ELSE h END::BIGINT AS value, count(*) AS n
        FROM (SELECT text, TRY_CAST(text AS HUGEINT) AS h FROM ({_shaped_sql(_INT_SHAPES)})) GROUP BY 1, 2""",
)
def strict_ints(spark, d):
    texts = feeds.source(spark, d, "lineitem").select(_shaped(_INT_SHAPES).alias("text"))
    return texts.groupBy("text", strict_int(F.col("text")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "strict_float",
    rf"""SELECT text, CASE WHEN regexp_full_match(text, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?')
                   THEN CAST(text AS DOUBLE) ELSE 0.0 END AS value, count(*) AS n
        FROM (SELECT CASE WHEN text LIKE '%\_%' ESCAPE '\' THEN text ELSE text END AS text
              FROM ({_shaped_sql(_FLOAT_SHAPES)})) GROUP BY 1, 2""",
)
def strict_floats(spark, d):
    texts = feeds.source(spark, d, "lineitem").select(_shaped(_FLOAT_SHAPES).alias("text"))
    return texts.groupBy("text", strict_float(F.col("text")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "trim_space",
    f"""SELECT doc_id, md5(regexp_replace(regexp_replace(padded, '^{_WS_SQL}+', ''), '{_WS_SQL}+$', '')) AS trimmed
        FROM (SELECT doc_id, chr(160) || ' ' || chr(9) || text || chr(8195) || chr(10) AS padded FROM documents)""",
)
def trimmed(spark, d):
    docs = feeds.source(spark, d, "documents")
    padded = F.concat(F.lit("\u00a0 \t"), F.col("text"), F.lit("\u2003\n"))
    return docs.select("doc_id", F.md5(trim_space(padded)).alias("trimmed"))


@query(
    "token_fields",
    f"""SELECT doc_id, len(t) AS tokens, md5(array_to_string(t, '|')) AS joined FROM (
          SELECT doc_id, list_filter(regexp_split_to_array(text || chr(160) || 'x', '{_WS_SQL}+'), lambda x: x <> '') AS t
          FROM documents)""",
)
def token_fields(spark, d):
    docs = feeds.source(spark, d, "documents")
    tokens = docs.select("doc_id", fields(F.concat("text", F.lit("\u00a0x"))).alias("t"))
    return tokens.select(
        "doc_id", F.size("t").cast("bigint").alias("tokens"), F.md5(F.array_join("t", "|")).alias("joined")
    )


@query(
    "first_nonzero",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 <> 0 THEN l_linenumber % 3 ELSE l_suppkey END AS value,
              count(*) AS n FROM lineitem GROUP BY 1, 2, 3""",
)
def nonzero(spark, d):
    value = first_nonzero(F.col("l_linenumber").cast("bigint") % 3, F.col("l_suppkey"))
    return feeds.source(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber", value.alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "first_nonempty",
    """SELECT c_custkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment ELSE c_name END AS value FROM customer""",
)
def nonempty(spark, d):
    segment = F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment"))
    return customers(spark, d).select("c_custkey", first_nonempty(segment, F.col("c_name")).alias("value"))


@query(
    "default_player_name",
    """SELECT p AS page_id, CASE WHEN v = 5 THEN player_id WHEN v IN (6, 3) THEN player_id ELSE 'Shooter ' || p END AS name
       FROM lg_shot_keys""",
)
def default_player_name(spark, d):
    keys = feeds.shot_page_keys(customers(spark, d))
    shown = F.when(F.col("variant").isin(3, 5, 6), "").otherwise(
        F.concat(F.lit("Shooter "), F.col("page_id").cast("string"))
    )
    return keys.select("page_id", first_nonempty(shown, F.col("player_id")).alias("name"))


@query(
    "zip_and_lookup",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber >= 3 THEN 'c' ELSE 'a' END AS a,
              CASE WHEN l_linenumber >= 2 THEN 'b' ELSE '' END AS b, '' AS z, count(*) AS n
       FROM lineitem GROUP BY ALL""",
)
def zip_and_lookup(spark, d):
    """Header keys a, b, a paired with 1..3 cells: the later a wins when its cell exists."""
    keys = F.array(F.lit("a"), F.lit("b"), F.lit("a"))
    cells = F.slice(
        F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit(1), F.least(F.col("l_linenumber"), F.lit(3))
    )
    rows = feeds.source(spark, d, "lineitem").withColumn("m", zip_last_wins(keys, cells))
    found = [lookup(F.col("m"), key).alias(key) for key in ("a", "b", "z")]
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", *found).groupBy(
        "l_orderkey", "l_linenumber", "l_partkey", "a", "b", "z"
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "class_tests",
    """SELECT cls, cls LIKE '%thead%' AS holds, list_contains(string_split(cls, ' '), 'thead') AS token, count(*) AS n
       FROM (SELECT CASE event_type WHEN 'click' THEN 'xthead' WHEN 'view' THEN 'row thead'
                    WHEN 'error' THEN '' ELSE event_type END AS cls FROM events) GROUP BY 1, 2, 3""",
)
def class_tests(spark, d):
    kind = F.col("event_type")
    cls = F.when(kind == "click", "xthead").when(kind == "view", "row thead").when(kind == "error", "").otherwise(kind)
    rows = events(spark, d).select(cls.alias("cls"))
    return rows.groupBy(
        "cls", F.col("cls").contains("thead").alias("holds"), has_class_token(F.col("cls"), "thead").alias("token")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "pixels",
    """SELECT event_id, CASE event_id % 4 WHEN 1 THEN 0 WHEN 3 THEN NULL ELSE event_id END AS px FROM events""",
)
def pixel_values(spark, d):
    """``left:7px`` and ``x:7`` give 7, ``left: 7px`` gives 0, no colon gives null."""
    number = F.col("event_id").cast("string")
    shape = F.pmod("event_id", F.lit(4))
    text = (
        F.when(shape == 0, F.concat(F.lit("left:"), number, F.lit("px")))
        .when(shape == 1, F.concat(F.lit("left: "), number, F.lit("px")))
        .when(shape == 2, F.concat(F.lit("x:"), number))
        .otherwise(F.concat(number, F.lit("px")))
    )
    return events(spark, d).select("event_id", pixels(text).alias("px"))


@query("key_hash", "SELECT c_custkey, upper(sha256(c_name)) AS hash FROM customer")
def hashes(spark, d):
    return customers(spark, d).select("c_custkey", F.hex(key_hash(F.col("c_name"))).alias("hash"))


@query(
    "status_text",
    "SELECT status, count(*) AS n FROM (SELECT CAST(status AS VARCHAR) AS status FROM lg_loadlog) GROUP BY 1",
)
def status_text(spark, d):
    from courtside.sources.requestlog import parse_request_lines

    log = parse_request_lines(feeds.load_lines(events(spark, d)))
    return log.groupBy(F.col("status").cast("string").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "elapsed_seconds",
    """SELECT event_id, CAST(epoch_us(ts + INTERVAL 1 MICROSECOND * CAST(floor(value * 1000) AS BIGINT)) - epoch_us(ts) AS DOUBLE)
              / 1000000 AS seconds FROM events""",
)
def elapsed(spark, d):
    micros = F.floor(F.col("value") * 1000).cast("bigint")
    end = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + micros).cast("timestamp_ntz")
    rows = events(spark, d).select("event_id", "ts", end.alias("end_ts"))
    return rows.select("event_id", elapsed_seconds("ts", "end_ts").alias("seconds"))


@query(
    "duration_text",
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN n * 1000 WHEN 1 THEN n * 1000 + 500 WHEN 2 THEN n * 1000000
                        WHEN 3 THEN n * 3600000000000 + 120000000000 + 250000000 WHEN 4 THEN n ELSE NULL END AS ns
       FROM (SELECT event_id, event_id % 100000 AS n FROM events)""",
)
def duration_texts(spark, d):
    n = F.pmod("event_id", F.lit(100000)).cast("string")
    shape = F.pmod("event_id", F.lit(6))
    text = (
        F.when(shape == 0, F.concat(n, F.lit("µs")))
        .when(shape == 1, F.concat(n, F.lit(".5μs")))
        .when(shape == 2, F.concat(n, F.lit("ms")))
        .when(shape == 3, F.concat(n, F.lit("h2m0.25s")))
        .when(shape == 4, F.concat(n, F.lit("ns")))
        .otherwise("soon")
    )
    return events(spark, d).select("event_id", duration_ns(text).alias("ns"))


@query(
    "shot_dates",
    "SELECT event_id, strftime(ts, '%b %-d,%Y') AS date, CAST(ts AS DATE) AS day FROM events",
)
def shot_dates(spark, d):
    rows = events(spark, d).select("event_id", F.date_format("ts", "MMM d,yyyy").alias("date"))
    return rows.withColumn("day", shot_date(F.col("date")))


@query(
    "json_documents",
    """SELECT c_custkey, c_name, c_mktsegment FROM customer""",
)
def json_documents(spark, d):
    """Rows encoded as JSON objects and read back."""
    encoded = customers(spark, d).select(F.to_json(F.struct("c_custkey", "c_name", "c_mktsegment")).alias("j"))
    return encoded.select(
        F.from_json("j", "c_custkey bigint, c_name string, c_mktsegment string").alias("r")
    ).select("r.*")
