"""Query specification: optional filters, whitelisted sort and paging arguments."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from courtside.schemas import AUDIT_COLUMNS, TableSpec
from courtside.sources.tables import visible

# Texts read as booleans, and the paging defaults.
TRUE_TEXTS = {"1", "t", "T", "true", "TRUE", "True"}
DEFAULT_PAGE, DEFAULT_PAGE_SIZE = 1, 20


def _int_or(text: str | None, default: int) -> int:
    """Integer parameter; anything unreadable or outside int64 takes the default."""
    if text is None or not re.fullmatch(r"[+-]?[0-9]+", text, re.ASCII):
        return default
    number = int(text)
    return number if -(2**63) <= number < 2**63 else default


@dataclass(frozen=True)
class StatQuery:
    """Filters are optional (None = no filter) and combine with AND."""

    season: int | None = None
    team: str | None = None
    player_id: str | None = None
    is_playoff: bool | None = None
    player_name: str | None = None
    name_contains: str | None = None
    sort_by: str | None = None
    ascending: bool = False
    page: int = DEFAULT_PAGE
    page_size: int = DEFAULT_PAGE_SIZE
    extended: bool = field(default=False, kw_only=True)

    def __post_init__(self):
        if self.page_size <= 0:
            raise ValueError("page size must be positive")

    @classmethod
    def from_params(cls, params: Mapping[str, str], aliases: bool = True) -> StatQuery:
        """Lenient form: unreadable numbers take defaults, empty text means no filter.

        ``aliases=False`` is the shot query, which knows only ``playerId`` and ``season``.
        """
        player = params.get("playerId") or (params.get("player_id") if aliases else None)
        season = _int_or(params.get("season"), 0) or None
        if not aliases:
            return cls(season=season, player_id=player or None)
        playoff = params.get("isPlayoff")
        return cls(
            season=season,
            team=params.get("team") or None,
            player_id=player or None,
            is_playoff=playoff in TRUE_TEXTS if playoff else None,
            sort_by=params.get("sortBy") or None,
            ascending=params.get("ascending") in TRUE_TEXTS,
            page=_int_or(params.get("page"), DEFAULT_PAGE),
            page_size=_int_or(params.get("pageSize"), DEFAULT_PAGE_SIZE),
        )

    @property
    def offset(self) -> int:
        """A page number below one reads the first page."""
        return max(0, (self.page - 1) * self.page_size)

    def predicate(self) -> Column:
        wanted = []
        for column in ("season", "team", "player_id", "is_playoff", "player_name"):
            value = getattr(self, column)
            if value is not None:
                wanted.append(F.col(column) == F.lit(value))
        if self.name_contains:
            wanted.append(name_contains(self.name_contains))
        return reduce(and_, wanted, F.lit(True))

    def order(self, spec: TableSpec) -> list[tuple[str, bool]]:
        """(column, descending) pairs: the sort column, then the natural key ascending."""
        first = spec.sort_column(self.sort_by, self.extended)
        rest = [key for key in spec.keys if key != first]
        return [(first, not self.ascending)] + [(key, False) for key in rest]


def name_contains(part: str) -> Column:
    """Case-insensitive containment; % and _ in the input are literal."""
    escaped = re.sub(r"([\\%_])", r"\\\1", part)
    return F.col("player_name").ilike(f"%{escaped}%")


def order_columns(order: list[tuple[str, bool]]) -> list[Column]:
    return [
        F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()
        for column, descending in order
    ]


def matching(rows: DataFrame, query: StatQuery) -> DataFrame:
    """Visible rows that satisfy every given filter; no order, no limit."""
    return visible(rows).filter(query.predicate())


def response_rows(rows: DataFrame, spec: TableSpec, with_audit: bool = False) -> DataFrame:
    """Columns renamed to their response names, in declared order."""
    names = dict(spec.response_names)
    if with_audit:
        names.update(AUDIT_COLUMNS)
    return rows.select(*[F.col(c).alias(r) for c, r in names.items() if c in rows.columns])
