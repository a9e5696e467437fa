"""Declared tables: columns, natural keys, merge policy and response names.

Everything else in the package is driven by the :class:`TableSpec` objects at the
bottom of this file, so the schema contract is stated exactly once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import types as T

LONG, DOUBLE, TEXT, FLAG = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType()

# Column, type, response name, page keys (first usable one wins).
TOTALS_COLUMNS = [
    ("external_id", LONG, "id", ("rk", "ranker")),
    ("player_id", TEXT, "playerId", ()),
    ("player_name", TEXT, "playerName", ("player", "name_display")),
    ("position", TEXT, "position", ("pos",)),
    ("age", LONG, "age", ("age",)),
    ("games", LONG, "games", ("games", "g")),
    ("games_started", LONG, "gamesStarted", ("games_started", "gs")),
    ("minutes_pg", DOUBLE, "minutesPg", ("mp",)),
    ("field_goals", LONG, "fieldGoals", ("fg",)),
    ("field_attempts", LONG, "fieldAttempts", ("fga",)),
    ("field_percent", DOUBLE, "fieldPercent", ("fg_pct",)),
    ("three_fg", LONG, "threeFg", ("fg3",)),
    ("three_attempts", LONG, "threeAttempts", ("fg3a",)),
    ("three_percent", DOUBLE, "threePercent", ("fg3_pct",)),
    ("two_fg", LONG, "twoFg", ("fg2",)),
    ("two_attempts", LONG, "twoAttempts", ("fg2a",)),
    ("two_percent", DOUBLE, "twoPercent", ("fg2_pct",)),
    ("effect_fg_percent", DOUBLE, "effectFgPercent", ("efg_pct",)),
    ("ft", LONG, "ft", ("ft",)),
    ("ft_attempts", LONG, "ftAttempts", ("fta",)),
    ("ft_percent", DOUBLE, "ftPercent", ("ft_pct",)),
    ("offensive_rb", LONG, "offensiveRb", ("orb",)),
    ("defensive_rb", LONG, "defensiveRb", ("drb",)),
    ("total_rb", LONG, "totalRb", ("trb",)),
    ("assists", LONG, "assists", ("ast",)),
    ("steals", LONG, "steals", ("stl",)),
    ("blocks", LONG, "blocks", ("blk",)),
    ("turnovers", LONG, "turnovers", ("tov",)),
    ("personal_fouls", LONG, "personalFouls", ("pf",)),
    ("points", LONG, "points", ("pts",)),
    ("team", TEXT, "team", ("team_id", "team_name_abbr")),
    ("season", LONG, "season", ()),
    ("is_playoff", FLAG, "isPlayoff", ()),
]

# Fixed values, same layout.
ADVANCED_COLUMNS = [
    ("external_id", LONG, "id", ("rk", "ranker")),
    ("player_id", TEXT, "playerId", ()),
    ("player_name", TEXT, "playerName", ("player", "name_display")),
    ("position", TEXT, "position", ("pos",)),
    ("age", LONG, "age", ("age",)),
    ("games", LONG, "games", ("games", "g")),
    ("minutes_played", LONG, "minutesPlayed", ("mp",)),
    ("per", DOUBLE, "per", ("per",)),
    ("ts_percent", DOUBLE, "tsPercent", ("ts_pct",)),
    ("three_par", DOUBLE, "threePAR", ("fg3a_per_fga_pct",)),
    ("ftr", DOUBLE, "ftr", ("fta_per_fga_pct",)),
    ("offensive_rb_percent", DOUBLE, "offensiveRBPercent", ("orb_pct",)),
    ("defensive_rb_percent", DOUBLE, "defensiveRBPercent", ("drb_pct",)),
    ("total_rb_percent", DOUBLE, "totalRBPercent", ("trb_pct",)),
    ("assist_percent", DOUBLE, "assistPercent", ("ast_pct",)),
    ("steal_percent", DOUBLE, "stealPercent", ("stl_pct",)),
    ("block_percent", DOUBLE, "blockPercent", ("blk_pct",)),
    ("turnover_percent", DOUBLE, "turnoverPercent", ("tov_pct",)),
    ("usage_percent", DOUBLE, "usagePercent", ("usg_pct",)),
    ("offensive_ws", DOUBLE, "offensiveWS", ("ows",)),
    ("defensive_ws", DOUBLE, "defensiveWS", ("dws",)),
    ("win_shares", DOUBLE, "winShares", ("ws",)),
    ("win_shares_per", DOUBLE, "winSharesPer", ("ws_per_48",)),
    ("offensive_box", DOUBLE, "offensiveBox", ("obpm",)),
    ("defensive_box", DOUBLE, "defensiveBox", ("dbpm",)),
    ("box", DOUBLE, "box", ("bpm",)),
    ("vorp", DOUBLE, "vorp", ("vorp",)),
    ("team", TEXT, "team", ("team_id", "team_name_abbr")),
    ("season", LONG, "season", ()),
    ("is_playoff", FLAG, "isPlayoff", ()),
]

# Fixed values, same layout; shot rows come from tooltips, so there are no page keys.
SHOT_COLUMNS = [
    ("player_id", TEXT, "playerId", ()),
    ("season", LONG, "season", ()),
    ("date", TEXT, "date", ()),
    ("qtr", TEXT, "qtr", ()),
    ("time_remaining", TEXT, "timeRemaining", ()),
    ("top", LONG, "top", ()),
    ("left", LONG, "left", ()),
    ("player_name", TEXT, "playerName", ()),
    ("result", FLAG, "result", ()),
    ("shot_type", TEXT, "shotType", ()),
    ("distance_ft", LONG, "distanceFt", ()),
    ("lead", FLAG, "lead", ()),
    ("team_score", LONG, "teamScore", ()),
    ("opponent_team_score", LONG, "opponentTeamScore", ()),
    ("opponent", TEXT, "opponent", ()),
    ("team", TEXT, "team", ()),
]

# Audit columns and the names they carry in a response.
AUDIT_COLUMNS = [
    ("created_at", "CreatedAt"),
    ("updated_at", "UpdatedAt"),
    ("deleted_at", "DeletedAt"),
]

# The names of a credential's fields in a response.
CREDENTIAL_RESPONSE = {
    "id": "ID",
    "hash": "Hash",
    "label": "Label",
    "revoked": "Revoked",
    "created_at": "CreatedAt",
    "revoked_at": "RevokedAt",
}

CREDENTIALS = T.StructType(
    [
        T.StructField("id", LONG, False),
        T.StructField("hash", T.BinaryType(), False),
        T.StructField("label", TEXT, False),
        T.StructField("revoked", FLAG, False),
        T.StructField("created_at", T.TimestampNTZType(), False),
        T.StructField("revoked_at", T.TimestampNTZType(), True),
    ]
)


@dataclass(frozen=True)
class TableSpec:
    """One stored table: what its rows look like and how they merge and sort."""

    name: str
    columns: tuple
    keys: tuple[str, ...]
    partition_by: tuple[str, ...]
    default_sort: str | None = None
    sort_keys: tuple[str, ...] = ()
    extended_sort_keys: tuple[str, ...] = ()
    buckets: int = 1

    @cached_property
    def names(self) -> list[str]:
        return [column for column, *_ in self.columns]

    @cached_property
    def updates(self) -> list[str]:
        """Columns a merge overwrites: every payload column, never keys or audit stamps."""
        return [column for column in self.names if column not in self.keys]

    @cached_property
    def response_names(self) -> dict[str, str]:
        return {column: response for column, _, response, _ in self.columns}

    @cached_property
    def page_keys(self) -> dict[str, tuple[str, ...]]:
        return {column: keys for column, _, _, keys in self.columns if keys}

    @cached_property
    def types(self) -> dict[str, T.DataType]:
        return {column: dtype for column, dtype, *_ in self.columns}

    @cached_property
    def schema(self) -> T.StructType:
        """Payload columns are never null; ``deleted_at`` is the one nullable column."""
        payload = [T.StructField(column, dtype, False) for column, dtype, *_ in self.columns]
        audit = [
            T.StructField(column, T.TimestampNTZType(), column == "deleted_at")
            for column, _ in AUDIT_COLUMNS
        ]
        return T.StructType(payload + audit)

    def sort_column(self, response_name: str | None, extended: bool = False) -> str:
        """Whitelisted sort: unknown names fall back to the default column."""
        allowed = self.sort_keys + (self.extended_sort_keys if extended else ())
        by_response = {self.response_names[column]: column for column in allowed}
        return by_response.get(response_name, self.default_sort)


_STAT_KEY = ("player_id", "season", "team", "is_playoff")

TOTALS = TableSpec(
    name="player_total_stats",
    columns=tuple(TOTALS_COLUMNS),
    keys=_STAT_KEY,
    partition_by=("season", "is_playoff"),
    default_sort="points",
    # Columns a caller may sort by.
    sort_keys=(
        "points", "assists", "total_rb", "games_started", "field_percent",
        "three_percent", "ft_percent", "player_id", "season", "team",
    ),
    extended_sort_keys=("blocks",),
    buckets=4,
)

ADVANCED = TableSpec(
    name="player_advanced_stats",
    columns=tuple(ADVANCED_COLUMNS),
    keys=_STAT_KEY,
    partition_by=("season", "is_playoff"),
    default_sort="win_shares",
    # Columns a caller may sort by.
    sort_keys=("win_shares", "per", "ts_percent", "player_id", "season", "team"),
    extended_sort_keys=("vorp", "usage_percent"),
    buckets=4,
)

SHOTS = TableSpec(
    name="player_shot_charts",
    columns=tuple(SHOT_COLUMNS),
    keys=("player_id", "season", "date", "qtr", "time_remaining", "top", "left"),
    partition_by=("season",),
    buckets=16,
)

TABLES = {spec.name: spec for spec in (TOTALS, ADVANCED, SHOTS)}
