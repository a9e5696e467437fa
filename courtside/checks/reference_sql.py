"""DuckDB statements of the derived tables, shared by the comparison queries."""

from __future__ import annotations

import re

from courtside.schemas import ADVANCED, TOTALS, TableSpec

# The thirty player positions and team codes follow from these rules.
_POSITION = "list_extract(['PG','SG','SF','PF','C'], CAST({k} % 5 + 1 AS INTEGER))"


def _ratio(part: str, whole: str) -> str:
    return f"CAST(floor(CAST(({part}) * 1000 AS DOUBLE) / ({whole}) + 0.5) AS DOUBLE) / 1000"


def _tenth(number: str) -> str:
    return f"CAST({number} AS DOUBLE) / 10"


_TOTALS = f"""
SELECT k + ln AS external_id, 'p' || lpad(CAST(k AS VARCHAR), 10, '0') AS player_id,
       'Player ' || CAST(k AS VARCHAR) AS player_name, {_POSITION.format(k='k')} AS position,
       k % 20 + 19 AS age, g AS games, a AS games_started, CAST(q * 2 AS DOUBLE) AS minutes_pg,
       r + ln AS field_goals, r + ln + q AS field_attempts, {_ratio('r + ln', 'r + ln + q')} AS field_percent,
       r AS three_fg, r + mx AS three_attempts, {_ratio('r', 'r + mx')} AS three_percent,
       ln AS two_fg, ln + q - mx AS two_attempts, {_ratio('ln', 'ln + q - mx')} AS two_percent,
       {_ratio('r * 2 + ln', 'r * 2 + ln + q')} AS effect_fg_percent,
       a AS ft, a + g AS ft_attempts, {_ratio('a', 'a + g')} AS ft_percent,
       mx AS offensive_rb, q AS defensive_rb, mx + q AS total_rb, ln * 3 AS assists, g + r AS steals,
       mx - r AS blocks, ln + a AS turnovers, g * 2 AS personal_fouls, q * 2 + ln AS points,
       team, season, is_playoff, created_at, updated_at,
       CASE WHEN k % 17 = 3 THEN updated_at END AS deleted_at
FROM lg_line
"""

_LINE = """
SELECT l_partkey AS k, CAST(year(l_shipdate) AS BIGINT) AS season,
       'T' || lpad(CAST(l_suppkey % 30 AS VARCHAR), 2, '0') AS team, l_linestatus = 'O' AS is_playoff,
       count(*) AS g, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q,
       max(CAST(l_quantity AS BIGINT)) AS mx, CAST(sum(l_linenumber) AS BIGINT) AS ln,
       count(*) FILTER (l_returnflag = 'R') AS r, count(*) FILTER (l_returnflag = 'A') AS a,
       min(l_shipdate) AS created_at, max(l_shipdate) AS updated_at
FROM lineitem GROUP BY 1, 2, 3, 4
"""

_ADVANCED = f"""
SELECT external_id, player_id, player_name, position, age, games, points * 2 AS minutes_played,
       {_tenth('(points % 400)')} AS per, effect_fg_percent AS ts_percent, three_percent AS three_par,
       ft_percent AS ftr, {_tenth('(offensive_rb % 300)')} AS offensive_rb_percent,
       {_tenth('(defensive_rb % 350)')} AS defensive_rb_percent, {_tenth('(total_rb % 250)')} AS total_rb_percent,
       {_tenth('(assists % 500)')} AS assist_percent, {_tenth('(steals % 50)')} AS steal_percent,
       {_tenth('(blocks % 80)')} AS block_percent, {_tenth('(turnovers % 300)')} AS turnover_percent,
       {_tenth('(field_attempts % 400)')} AS usage_percent, {_tenth('(assists % 130)')} AS offensive_ws,
       {_tenth('(steals % 70)')} AS defensive_ws, {_tenth('(assists % 130 + steals % 70)')} AS win_shares,
       CAST(points % 300 AS DOUBLE) / 1000 AS win_shares_per, {_tenth('(points % 150 - 70)')} AS offensive_box,
       {_tenth('(total_rb % 100 - 50)')} AS defensive_box,
       {_tenth('(points % 150 + total_rb % 100 - 120)')} AS box, {_tenth('(points % 110 - 20)')} AS vorp,
       team, season, is_playoff, created_at, updated_at, deleted_at
FROM lg_totals
"""

_SHOTS = """
SELECT 'p' || lpad(CAST(user_id AS VARCHAR), 10, '0') AS player_id, CAST(year(ts) AS BIGINT) AS season,
       strftime(ts, '%b %-d,%Y') AS date,
       CASE hour(ts) % 4 WHEN 0 THEN '1st Qtr' WHEN 1 THEN '2nd Qtr' WHEN 2 THEN '3rd Qtr' ELSE '4th Qtr' END AS qtr,
       lpad(CAST(minute(ts) % 12 AS VARCHAR), 2, '0') || ':' || lpad(CAST(second(ts) AS VARCHAR), 2, '0') AS time_remaining,
       event_id // 500 AS top, event_id % 500 AS "left", 'Player ' || CAST(user_id AS VARCHAR) AS player_name,
       event_type IN ('click', 'purchase') AS result,
       CASE WHEN event_id % 3 = 0 THEN '3-pointer' ELSE '2-pointer' END AS shot_type, event_id % 30 AS distance_ft,
       event_id % 120 > (event_id * 3) % 120 AS lead, event_id % 120 AS team_score,
       (event_id * 3) % 120 AS opponent_team_score,
       'T' || lpad(CAST((user_id + 1) % 30 AS VARCHAR), 2, '0') AS opponent,
       'T' || lpad(CAST(user_id % 30 AS VARCHAR), 2, '0') AS team, ts AS created_at, ts AS updated_at,
       CASE WHEN event_id % 23 = 5 THEN ts END AS deleted_at
FROM events
"""

_REQUESTS = """
SELECT *, CASE WHEN raw_key IS NOT NULL THEN sha256(raw_key) END AS hash FROM (
SELECT event_id AS request_id, ts, 'GET' AS method,
       CASE event_type WHEN 'click' THEN '/api/playertotals/' WHEN 'signup' THEN '/api/playershotchart/'
                       ELSE '/api/playeradvancedstats/' END AS endpoint,
       CASE WHEN event_type = 'error' THEN '500' ELSE '200' END AS status,
       'api' || CAST(user_id % 3 + 1 AS VARCHAR) || ':5000' AS instance, 'stats-api' AS job,
       value / 100 AS duration_s,
       CASE WHEN event_id % 11 = 0 THEN 'bogus-' || CAST(user_id AS VARCHAR)
            WHEN event_id % 13 <> 1 THEN 'key-' || CAST(user_id AS VARCHAR) END AS raw_key
FROM events)
"""

_KEYS = """
SELECT c_custkey AS id, sha256('key-' || CAST(c_custkey AS VARCHAR)) AS hash, c_mktsegment AS label,
       c_custkey % 7 = 0 AS revoked, TIMESTAMP '2023-12-01 00:00:00' AS created_at,
       CASE WHEN c_custkey % 19 = 4 THEN TIMESTAMP '2023-12-01 00:00:00' END AS revoked_at
FROM customer
"""

_SAMPLES = """
SELECT ts, job, instance, method, endpoint, status,
       CAST(sum(n) OVER (PARTITION BY job, instance, method, endpoint, status, ts >= TIMESTAMP '2024-01-15 00:00:00'
                         ORDER BY ts) AS BIGINT) AS value
FROM (SELECT date_trunc('hour', ts) AS ts, job, instance, method, endpoint, status, count(*) AS n
      FROM lg_requests GROUP BY 1, 2, 3, 4, 5, 6)
"""

_LOADLINES = """
SELECT CASE WHEN event_id % 13 = 0 THEN 'Request ' || event_id || ' failed: timeout'
            WHEN event_id % 29 = 1 THEN 'Request ' || event_id || ' failed to create request: bad address'
            WHEN event_id % 31 = 2 THEN 'Failed to read response body: EOF'
            ELSE '2024/01/01 00:00:00 Request ' || event_id || ': Status=' ||
                 CASE WHEN event_type = 'error' THEN '500' ELSE '200' END || ', Time=' || amount END AS line,
       event_id, event_type, ns
FROM (SELECT *, CASE event_id % 5 WHEN 0 THEN tenths || 'µs' WHEN 1 THEN '1m' || (tenths % 60) || '.5s'
                                  WHEN 2 THEN (tenths % 10) || '.25s' ELSE tenths || 'ms' END AS amount,
             CASE event_id % 5 WHEN 0 THEN tenths * 1000 WHEN 1 THEN 60500000000 + (tenths % 60) * 1000000000
                               WHEN 2 THEN (tenths % 10) * 1000000000 + 250000000 ELSE tenths * 1000000 END AS ns
      FROM (SELECT *, CAST(floor(value * 10) AS BIGINT) AS tenths FROM events))
"""

# The log lines as results, built from the numbers they were written from.
_LOADLOG = """
SELECT event_id AS request_id,
       CASE WHEN event_id % 13 <> 0 AND event_id % 29 <> 1
            THEN CASE WHEN event_type = 'error' THEN 500 ELSE 200 END END::BIGINT AS status,
       CASE WHEN event_id % 13 <> 0 AND event_id % 29 <> 1 THEN ns END::BIGINT AS duration_ns,
       CASE WHEN event_id % 13 = 0 THEN 'timeout' WHEN event_id % 29 = 1 THEN 'bad address' END AS error
FROM lg_loadlines WHERE event_id % 13 = 0 OR event_id % 29 = 1 OR event_id % 31 <> 2
"""

_PAGE_KEYS = """
SELECT c_custkey AS p, c_custkey % 12 + 1991 AS season, (c_custkey // 12) % 2 = 1 AS is_playoff,
       (c_custkey // 24) % 12 AS v
FROM customer
"""

_PAGE_ROWS = """
SELECT p, season, is_playoff, v, i FROM (SELECT *, unnest(range(1, p % 5 + 2)) AS i FROM lg_page_keys)
WHERE v NOT IN (7, 8, 11)
"""

_SHOT_KEYS = """
SELECT c_custkey AS p, 'p' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS player_id,
       c_custkey % 5 + 2020 AS season, c_custkey % 8 AS v
FROM customer
"""

_SHOT_POINTS = """
SELECT p, player_id, season, v, i, (p + i) % 2 = 0 AS made, p % 30 AS home, (p + 1) % 30 AS away
FROM (SELECT *, unnest(range(1, p % 6 + 2)) AS i FROM lg_shot_keys) WHERE v NOT IN (3, 4, 6)
"""

_SHOT_ROWS = """
SELECT p AS page_id, player_id, season, 'Jan ' || (p % 28 + 1) || ',2024' AS date, '2nd Qtr' AS qtr,
       lpad(CAST(i % 12 AS VARCHAR), 2, '0') || ':30' AS time_remaining, p % 300 + i * 2 AS top,
       CASE WHEN i = 3 THEN 0 ELSE p % 400 + i END AS "left",
       CASE WHEN v = 5 THEN player_id ELSE 'Shooter ' || p END AS player_name, made AS result,
       '3-pointer' AS shot_type, i + 20 AS distance_ft, p % 100 + i > (p * 3) % 100 + 2 AS lead,
       p % 100 + i AS team_score, (p * 3) % 100 + 2 AS opponent_team_score,
       CASE WHEN i <= 2 THEN 'T' || lpad(CAST(away AS VARCHAR), 2, '0') ELSE '' END AS opponent,
       CASE WHEN i <= 2 THEN 'T' || lpad(CAST(home AS VARCHAR), 2, '0') ELSE '' END AS team
FROM lg_shot_points WHERE NOT (v = 7 AND i = 2)
"""


def _cell_value(spec: TableSpec, column: str) -> str:
    """What a rendered cell must come back as, straight from the page and row numbers."""
    shown = [c for c in spec.names if c in spec.page_keys]
    place = spec.names.index(column)
    number = f"(p * 7 + i * 13 + {place} * 5) % (90 + {place})"
    kind = spec.types[column].simpleString()
    if column == "player_id":
        return "'x' || p || '-' || i"
    if column == "player_name":
        value, missing = "'O''Neil & Co ' || p || '-' || i", "''"
    elif column == "team":
        value, missing = "'T' || lpad(CAST((p + i) % 30 AS VARCHAR), 2, '0')", "''"
    elif column == "position":
        value = f"CASE WHEN v = 6 THEN 'XX' ELSE {_POSITION.format(k='(p + i)')} END"
        missing = "''"
    elif column in ("season", "is_playoff"):
        return column
    elif column == "age":
        value, missing = f"CASE WHEN i = 3 THEN 0 ELSE {number} END", "0"
    elif kind == "bigint":
        value, missing = f"CASE WHEN i = 2 AND {number} % 4 = 0 THEN 0 ELSE {number} END", "0"
    else:
        value, missing = f"CAST({number} AS DOUBLE) / 1000", "0.0"
    if column in shown[-5:]:
        value = f"CASE WHEN v = 4 AND i = 1 THEN {missing} ELSE {value} END"
    return value


def _stat_rows(spec: TableSpec, dropped: str) -> str:
    columns = ", ".join(f"{_cell_value(spec, c)} AS {c}" for c in spec.names)
    return f"SELECT p AS page_id, {columns} FROM lg_page_rows WHERE NOT (v = 9 AND i = 1) AND {dropped}"


CTES = {
    "lg_line": _LINE,
    "lg_totals": _TOTALS,
    "lg_advanced": _ADVANCED,
    "lg_shots": _SHOTS,
    "lg_requests": _REQUESTS,
    "lg_keys": _KEYS,
    "lg_samples": _SAMPLES,
    "lg_loadlines": _LOADLINES,
    "lg_loadlog": _LOADLOG,
    "lg_page_keys": _PAGE_KEYS,
    "lg_page_rows": _PAGE_ROWS,
    # The plain class test drops rows of class xthead (row 4); the token test keeps them.
    "lg_totals_rows": _stat_rows(TOTALS, "i <> 4"),
    "lg_advanced_rows": _stat_rows(ADVANCED, "TRUE"),
    "lg_shot_keys": _SHOT_KEYS,
    "lg_shot_points": _SHOT_POINTS,
    "lg_shot_rows": _SHOT_ROWS,
}


def statement(sql: str) -> str:
    """The query with exactly the derived tables it needs in front of it."""
    wanted: set[str] = set()

    def need(text: str) -> None:
        for name in re.findall(r"\blg_\w+\b", text):
            if name in CTES and name not in wanted:
                wanted.add(name)
                need(CTES[name])

    need(sql)
    if not wanted:
        return sql.strip()
    parts = ", ".join(f"{name} AS ({CTES[name].strip()})" for name in CTES if name in wanted)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {parts}, {body[5:]}"
    return f"WITH {parts} {body}"
