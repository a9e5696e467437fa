"""League tables, pages, request logs and credentials derived from the given tables.

These feed the registered queries. Every derivation is a projection, or an aggregate that combines before
its shuffle or over narrow ranges of its key, so it grows with the given tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from courtside.functions.text import season_page_url, shot_page_url
from courtside.schemas import ADVANCED, SHOTS, TOTALS, TableSpec

# Fixed values used by the derivations.
POSITIONS = ["PG", "SG", "SF", "PF", "C"]
JOB = "stats-api"
# Lines that a task counts, sorts and stores as wide rows.
LINES_PER_TASK = 250_000


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _player(number: Column) -> Column:
    return F.concat(F.lit("p"), F.lpad(number.cast("string"), 10, "0"))


def _team(number: Column) -> Column:
    return F.concat(F.lit("T"), F.lpad(F.pmod(number, F.lit(30)).cast("string"), 2, "0"))


def _ratio(part: Column, whole: Column) -> Column:
    """Ratio to three places, rounded through whole thousandths so that engines agree."""
    return F.floor(part * 1000 / whole + 0.5) / F.lit(1000.0)


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Season totals: one row per (part, year, supplier team, line status)."""
    line = source(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("k"),
        F.year("l_shipdate").cast("bigint").alias("season"),
        _team(F.col("l_suppkey")).alias("team"),
        (F.col("l_linestatus") == "O").alias("is_playoff"),
        F.col("l_linenumber").cast("bigint").alias("ln"),
        F.col("l_quantity").cast("bigint").alias("q"),
        "l_returnflag",
        "l_shipdate",
    )
    # Nearly every line is a row of its own, so counting ahead of the shuffle would only fill memory. The narrow lines
    # are dealt out once, in the ranges the table is stored in; neither the counts nor the table need another shuffle.
    # By number, since Spark would join such small ranges to tasks that are large once the rows are wide.
    dealt = line.repartitionByRange(max(1, -(-line.count() // LINES_PER_TASK)), "season", "is_playoff", "k")
    base = dealt.groupBy("k", "season", "team", "is_playoff").agg(
        F.count(F.lit(1)).alias("g"),
        F.sum("q").alias("q"),
        F.max("q").alias("mx"),
        F.sum("ln").alias("ln"),
        F.count_if(F.col("l_returnflag") == "R").alias("r"),
        F.count_if(F.col("l_returnflag") == "A").alias("a"),
        F.min("l_shipdate").alias("created_at"),
        F.max("l_shipdate").alias("updated_at"),
    )
    k, g, q, mx, ln, r, a = (F.col(c) for c in ("k", "g", "q", "mx", "ln", "r", "a"))
    return base.select(
        (k + ln).alias("external_id"),
        _player(k).alias("player_id"),
        F.concat(F.lit("Player "), k.cast("string")).alias("player_name"),
        F.element_at(F.array(*map(F.lit, POSITIONS)), (F.pmod(k, F.lit(5)) + 1).cast("int")).alias("position"),
        (F.pmod(k, F.lit(20)) + 19).alias("age"),
        g.alias("games"),
        a.alias("games_started"),
        (q * 2).cast("double").alias("minutes_pg"),
        (r + ln).alias("field_goals"),
        (r + ln + q).alias("field_attempts"),
        _ratio(r + ln, r + ln + q).alias("field_percent"),
        r.alias("three_fg"),
        (r + mx).alias("three_attempts"),
        _ratio(r, r + mx).alias("three_percent"),
        ln.alias("two_fg"),
        (ln + q - mx).alias("two_attempts"),
        _ratio(ln, ln + q - mx).alias("two_percent"),
        _ratio(r * 2 + ln, r * 2 + ln + q).alias("effect_fg_percent"),
        a.alias("ft"),
        (a + g).alias("ft_attempts"),
        _ratio(a, a + g).alias("ft_percent"),
        mx.alias("offensive_rb"),
        q.alias("defensive_rb"),
        (mx + q).alias("total_rb"),
        (ln * 3).alias("assists"),
        (g + r).alias("steals"),
        (mx - r).alias("blocks"),
        (ln + a).alias("turnovers"),
        (g * 2).alias("personal_fouls"),
        (q * 2 + ln).alias("points"),
        "team",
        "season",
        "is_playoff",
        "created_at",
        "updated_at",
        F.when(F.pmod(k, F.lit(17)) == 3, F.col("updated_at")).alias("deleted_at"),
    )


def advanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Season advanced stats on the same keys: whole-number tenths and hundredths."""
    t = totals(spark, sf_dir)
    tenth = {
        "per": F.col("points") % 400,
        "offensive_rb_percent": F.col("offensive_rb") % 300,
        "defensive_rb_percent": F.col("defensive_rb") % 350,
        "total_rb_percent": F.col("total_rb") % 250,
        "assist_percent": F.col("assists") % 500,
        "steal_percent": F.col("steals") % 50,
        "block_percent": F.col("blocks") % 80,
        "turnover_percent": F.col("turnovers") % 300,
        "usage_percent": F.col("field_attempts") % 400,
        "offensive_ws": F.col("assists") % 130,
        "defensive_ws": F.col("steals") % 70,
        "win_shares": F.col("assists") % 130 + F.col("steals") % 70,
        "offensive_box": F.col("points") % 150 - 70,
        "defensive_box": F.col("total_rb") % 100 - 50,
        "box": F.col("points") % 150 + F.col("total_rb") % 100 - 120,
        "vorp": F.col("points") % 110 - 20,
    }
    value = {name: number / F.lit(10.0) for name, number in tenth.items()} | {
        "minutes_played": F.col("points") * 2,
        "ts_percent": F.col("effect_fg_percent"),
        "three_par": F.col("three_percent"),
        "ftr": F.col("ft_percent"),
        "win_shares_per": (F.col("points") % 300) / F.lit(1000.0),
    }
    names = ADVANCED.names + ["created_at", "updated_at", "deleted_at"]
    return t.select(*[value.get(c, F.col(c)).alias(c) for c in names])


def shots(events: DataFrame) -> DataFrame:
    """One shot per event; (top, left) numbers the event, so the seven-column key is unique."""
    e, u = F.col("event_id"), F.col("user_id")
    home, away = F.pmod(e, F.lit(120)), F.pmod(e * 3, F.lit(120))
    quarters = F.array(*map(F.lit, ["1st Qtr", "2nd Qtr", "3rd Qtr", "4th Qtr"]))
    return events.select(
        _player(u).alias("player_id"),
        F.year("ts").cast("bigint").alias("season"),
        F.date_format("ts", "MMM d,yyyy").alias("date"),
        F.get(quarters, F.pmod(F.hour("ts"), F.lit(4))).alias("qtr"),
        F.format_string("%02d:%02d", F.pmod(F.minute("ts"), F.lit(12)), F.second("ts")).alias("time_remaining"),
        F.expr("event_id div 500").alias("top"),
        F.pmod(e, F.lit(500)).alias("left"),
        F.concat(F.lit("Player "), u.cast("string")).alias("player_name"),
        F.col("event_type").isin("click", "purchase").alias("result"),
        F.when(F.pmod(e, F.lit(3)) == 0, "3-pointer").otherwise("2-pointer").alias("shot_type"),
        F.pmod(e, F.lit(30)).alias("distance_ft"),
        (home > away).alias("lead"),
        home.alias("team_score"),
        away.alias("opponent_team_score"),
        _team(u + 1).alias("opponent"),
        _team(u).alias("team"),
        F.col("ts").alias("created_at"),
        F.col("ts").alias("updated_at"),
        F.when(F.pmod(e, F.lit(23)) == 5, F.col("ts")).alias("deleted_at"),
    )


def requests(events: DataFrame) -> DataFrame:
    """Request log, one request per event. Works on a stream of events too."""
    u, kind = F.col("user_id").cast("string"), F.col("event_type")
    raw = F.when(F.pmod("event_id", F.lit(11)) == 0, F.concat(F.lit("bogus-"), u)).when(
        F.pmod("event_id", F.lit(13)) != 1, F.concat(F.lit("key-"), u)
    )
    return events.select(
        F.col("event_id").alias("request_id"),
        "ts",
        F.lit("GET").alias("method"),
        F.when(kind == "click", "/api/playertotals/")
        .when(kind == "signup", "/api/playershotchart/")
        .otherwise("/api/playeradvancedstats/")
        .alias("endpoint"),
        F.when(kind == "error", 500).otherwise(200).cast("string").alias("status"),
        F.concat(F.lit("api"), (F.pmod("user_id", F.lit(3)) + 1).cast("string"), F.lit(":5000")).alias("instance"),
        F.lit(JOB).alias("job"),
        (F.col("value") / 100).alias("duration_s"),
        raw.alias("raw_key"),
        F.sha2(raw, 256).alias("hash"),
    )


def credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One credential per customer; some revoked, some soft-deleted."""
    k = F.col("c_custkey")
    at = F.lit("2023-12-01 00:00:00").cast("timestamp_ntz")
    return source(spark, sf_dir, "customer").select(
        k.alias("id"),
        F.sha2(F.concat(F.lit("key-"), k.cast("string")), 256).alias("hash"),
        F.col("c_mktsegment").alias("label"),
        (F.pmod(k, F.lit(7)) == 0).alias("revoked"),
        at.alias("created_at"),
        F.when(F.pmod(k, F.lit(19)) == 4, at).alias("revoked_at"),
    )


def samples(events: DataFrame) -> DataFrame:
    """Hourly cumulative counters per series, restarted from zero on 2024-01-15."""
    from courtside.operators.ordered import running_sum

    series = ["job", "instance", "method", "endpoint", "status"]
    hourly = (
        requests(events)
        .groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), *series)
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("era", F.col("ts") >= F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
    )
    return running_sum(hourly, [*series, "era"], "ts", "n", "value").select("ts", *series, "value")


def load_lines(events: DataFrame) -> DataFrame:
    """Load-test log lines in every shape the log has, with durations in several units."""
    i = F.col("event_id").cast("string")
    tenths = F.floor(F.col("value") * 10).cast("bigint")
    amount = (
        F.when(F.pmod("event_id", F.lit(5)) == 0, F.concat(tenths.cast("string"), F.lit("µs")))
        .when(F.pmod("event_id", F.lit(5)) == 1, F.concat(F.lit("1m"), (tenths % 60).cast("string"), F.lit(".5s")))
        .when(F.pmod("event_id", F.lit(5)) == 2, F.concat((tenths % 10).cast("string"), F.lit(".25s")))
        .otherwise(F.concat(tenths.cast("string"), F.lit("ms")))
    )
    status = F.when(F.col("event_type") == "error", "500").otherwise("200")
    line = (
        F.when(F.pmod("event_id", F.lit(13)) == 0, F.concat(F.lit("Request "), i, F.lit(" failed: timeout")))
        .when(
            F.pmod("event_id", F.lit(29)) == 1,
            F.concat(F.lit("Request "), i, F.lit(" failed to create request: bad address")),
        )
        .when(F.pmod("event_id", F.lit(31)) == 2, F.lit("Failed to read response body: EOF"))
        .otherwise(
            F.concat(F.lit("2024/01/01 00:00:00 Request "), i, F.lit(": Status="), status, F.lit(", Time="), amount)
        )
    )
    return events.select(line.alias("line"))


# --- pages -------------------------------------------------------------------------

# Page variants of the statistics feed, by customer key modulo 12.
NO_TABLE, WRONG_PLACE, OVERLONG, EMPTY, OLD_KEYS, TERSE, SHORT, DOUBLED = 7, 8, 9, 11, 5, 10, 4, 6


# Header keys by which newer pages name the columns that older ones name as on the left.
NEW_NAMES = {"rk": "ranker", "player": "name_display", "team_id": "team_name_abbr", "g": "games", "gs": "games_started"}


# A rendered page has some 3 kB and a megabyte of pages is about half a second of work.
PAGES_PER_TASK = 1000


def page_seeds(customers: DataFrame) -> DataFrame:
    """Customer keys, dealt out by the pages they become: a page is much larger than its seed row."""
    tasks = -(-customers.count() // PAGES_PER_TASK)
    return customers.select("c_custkey").repartition(max(tasks, 1), "c_custkey")


def stat_page_keys(customers: DataFrame, spec: TableSpec) -> DataFrame:
    """(page_id, url, season, is_playoff, variant): one season page per customer."""
    k = F.col("c_custkey")
    season = (F.pmod(k, F.lit(12)) + 1991).alias("season")
    keyed = page_seeds(customers).select(
        k.alias("page_id"),
        season,
        F.expr("pmod(c_custkey div 12, 2) = 1").alias("is_playoff"),
        F.expr("pmod(c_custkey div 24, 12)").alias("variant"),
    )
    return keyed.withColumn("url", season_page_url(spec.name, F.col("season"), F.col("is_playoff")))


def stat_value(column: str, spec: TableSpec, page: Column, row: Column) -> Column:
    """Number shown in a cell: whole, from the page, the row and the column's position."""
    place = spec.names.index(column)
    return F.pmod(page * 7 + row * 13 + place * 5, F.lit(90 + place))


def stat_pages(customers: DataFrame, spec: TableSpec) -> DataFrame:
    """Rendered season pages with the quirks the reader has to handle.

    Rows 1..n hold players; row 2 is followed by a repeated header and the last row is a
    league average without a player. See the variant constants for whole-page quirks.
    """
    p, v = F.col("page_id"), F.col("variant")
    old = v == OLD_KEYS
    columns = [c for c in spec.names if c in spec.page_keys]

    def key(column: str) -> Column:
        keys = spec.page_keys[column]
        if len(keys) == 1:
            return F.lit(keys[0])
        older = next(k for k in keys if k in NEW_NAMES)
        return F.when(old, F.lit(older)).otherwise(F.lit(NEW_NAMES[older]))

    def th(name: Column) -> Column:
        return F.concat(F.lit('<th class="x" data-stat="'), name, F.lit('">'), name, F.lit("</th>"))

    tag_end = F.when(v == TERSE, F.lit("")).otherwise(F.lit("</td>"))

    def cell(column: str, row: Column) -> Column:
        number = stat_value(column, spec, p, row)
        if column == "player_name":
            body = F.format_string(
                '<td data-append-csv="%s"> <a href="/p?a=1&amp;b=2">O&#39;Neil <b>&amp;</b> Co %s-%s</a>\n',
                F.concat(F.lit("x"), p.cast("string"), F.lit("-"), row.cast("string")), p, row,
            )
            return F.concat(body, tag_end)
        if column == "team":
            shown = _team(p + row)
        elif column == "position":
            shown = F.element_at(F.array(*map(F.lit, POSITIONS)), (F.pmod(p + row, F.lit(5)) + 1).cast("int"))
        elif column == "age":
            shown = F.when(row == 3, F.lit("")).otherwise(number.cast("string"))
        elif spec.types[column].simpleString() == "bigint":
            shown = F.when((row == 2) & (number % 4 == 0), F.lit("n/a")).otherwise(number.cast("string"))
        else:
            shown = F.concat(F.lit("."), F.lpad(number.cast("string"), 3, "0"))
        return F.concat(F.lit("<td> "), shown, F.lit(" "), tag_end)

    header = F.concat(
        F.lit("<thead><tr class='over_header'><th colspan=4>Per season</th></tr><tr>"),
        *[th(key(c)) for c in columns],
        F.when(v == DOUBLED, th(F.lit("pos"))).otherwise(F.lit("")),
        F.lit("</tr></thead>"),
    )
    row_end = F.when(v == TERSE, F.lit("")).otherwise(F.lit("</tr>"))

    def body_row(row: Column) -> Column:
        shown = columns[: len(columns) - 5]
        cells = F.concat(*[cell(c, row) for c in shown])
        rest = F.concat(*[cell(c, row) for c in columns[len(columns) - 5 :]])
        opening = F.when(row == 4, F.lit('<tr class="xthead">')).otherwise(F.lit("<tr>"))
        extra = F.when(
            (v == OVERLONG) & (row == 1), F.lit("<td>1</td><td>2</td>")
        ).when(v == DOUBLED, F.lit("<td>XX</td>")).otherwise(F.lit(""))
        repeated = F.when(
            row == 2, F.lit("<tr class=\"thead\"><th data-stat='ranker'>Rk</th><th>Player</th></tr>")
        ).otherwise(F.lit(""))
        return F.concat(
            opening, cells, F.when((v == SHORT) & (row == 1), F.lit("")).otherwise(rest), extra, row_end, repeated
        )

    count = F.when(v == EMPTY, F.lit(0)).otherwise(F.pmod(p, F.lit(5)) + 1).cast("int")
    numbers = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    body = F.concat(
        F.lit("<tbody>"),
        F.array_join(F.transform(numbers, body_row), "\n"),
        F.lit("<tr><th>0</th><td>League Average</td></tr></tbody>"),
    )
    advanced_page = spec is ADVANCED
    table_id = (
        F.when(F.col("is_playoff"), "advanced_stats").otherwise("advanced") if advanced_page else F.lit("totals_stats")
    )
    table_tag = F.when(v == TERSE, F.lit("<TABLE id=")).otherwise(F.lit('<table class="stats" id='))
    table = F.concat(table_tag, table_id, F.lit(">"), header, body, F.lit("</table>"))
    # The advanced table of every second page sits in a comment below its wrapper.
    shown = F.col("table_markup")
    commented = F.concat(F.lit("<!-- "), shown, F.lit(" -->"))
    if advanced_page:
        placed = F.when(v == WRONG_PLACE, F.concat(F.lit("</div><div>"), shown)).when(
            F.pmod(p, F.lit(2)) == 1, commented
        ).otherwise(shown)
    else:
        placed = F.when(v == WRONG_PLACE, commented).otherwise(shown)
    placed = F.when(v == NO_TABLE, F.lit("<p>Not found <b>today")).otherwise(placed)
    wrapper = F.when(F.col("is_playoff"), "all_advanced_stats").otherwise("all_advanced")
    html = F.concat(
        F.lit('<!DOCTYPE html><html><head><title>Stats</title><script>var a="<table id=totals_stats>";</script></head>'),
        F.lit('<body><p>Intro<div id="'), wrapper, F.lit('">'), placed, F.lit("</div></body></html>"),
    )
    keyed = stat_page_keys(customers, spec).withColumn("table_markup", table)
    return keyed.select("page_id", "url", html.alias("html"))


# Page variants of the shot feed, by customer key modulo 8.
NO_COMMENT, NO_WRAPPER, NO_NAME, HTTP_ERROR, TRUNCATED = 3, 4, 5, 6, 7


def shot_page_keys(customers: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    keyed = page_seeds(customers).select(
        k.alias("page_id"),
        _player(k).alias("player_id"),
        (F.pmod(k, F.lit(5)) + 2020).alias("season"),
        F.pmod(k, F.lit(8)).alias("variant"),
        F.when(F.pmod(k, F.lit(8)) == HTTP_ERROR, 404).otherwise(200).alias("http_status"),
    )
    return keyed.withColumn("url", shot_page_url(F.col("player_id"), F.col("season")))


def shot_pages(customers: DataFrame) -> DataFrame:
    """Rendered shot-chart pages: rows 1..n are tooltips in a comment."""
    p, v = F.col("page_id"), F.col("variant")

    def point(row: Column) -> Column:
        made = F.pmod(p + row, F.lit(2)) == 0
        left = F.when(row == 3, F.lit(" 44px")).otherwise(F.concat((p % 400 + row).cast("string"), F.lit("px")))
        place = F.when(row == 1, " at ").when(row == 2, " vs ").otherwise(" against ")
        tip = F.concat(
            F.lit("Jan "), (F.pmod(p, F.lit(28)) + 1).cast("string"), F.lit(", 2024, "), _team(p), place, _team(p + 1),
            F.when((v == TRUNCATED) & (row == 2), F.lit("")).otherwise(
                F.concat(
                    F.lit("&lt;br&gt;"), F.lit("2nd Qtr, "), F.lpad((row % 12).cast("string"), 2, "0"),
                    F.lit(":30 remaining&lt;br&gt;"),
                    F.when(made, "Made ").otherwise("Missed "), F.lit("3-pointer from "),
                    (row + 20).cast("string"), F.lit(" ft&lt;br&gt;"), _team(p), F.lit(" leads "),
                    (F.pmod(p, F.lit(100)) + row).cast("string"), F.lit("-"),
                    (F.pmod(p * 3, F.lit(100)) + 2).cast("string"),
                )
            ),
        )
        return F.concat(
            F.when(made, F.lit('<div class="tooltip make"')).otherwise(F.lit("<div class='miss tooltip'")),
            F.lit(' style="top:'), (F.pmod(p, F.lit(300)) + row * 2).cast("string"), F.lit("px;left:"), left,
            F.lit(';" tip="'), tip, F.lit('">&#9679;</div>'),
        )

    numbers = F.sequence(F.lit(1), (F.pmod(p, F.lit(6)) + 1).cast("int"))
    points = F.array_join(F.transform(numbers, point), "")
    wrapper_id = F.when(v == NO_WRAPPER, F.lit("other")).otherwise(F.lit("shot-wrapper"))
    chart = F.concat(
        F.lit('<div id="div_shot-chart"><div id="'), wrapper_id,
        F.lit('"><div class="tooltip">legend</div>'), points, F.lit("</div></div>"),
    )
    shown = F.when(v == NO_COMMENT, chart).otherwise(
        F.concat(F.lit("<!-- ad --><!-- "), chart, F.lit(" -->"))
    )
    name = F.when(v == NO_NAME, F.lit("")).otherwise(
        F.concat(F.lit('<span itemprop="name">Shooter '), p.cast("string"), F.lit("</span>"))
    )
    html = F.concat(
        F.lit('<html><body><span itemprop="name">Site</span><div id="meta">'), name,
        F.lit("<br></div><div>"), shown, F.lit("</div>"),
    )
    return shot_page_keys(customers).select("page_id", "url", "http_status", html.alias("html"))
