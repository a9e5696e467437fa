"""Text helpers for pages, tooltips, credentials and request logs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from courtside.functions.coerce import SPACE, strict_int

# Page addresses by table and season phase.
SEASON_PAGES = {
    "player_total_stats": {
        False: "https://www.basketball-reference.com/leagues/NBA_%d_totals.html",
        True: "https://www.basketball-reference.com/playoffs/NBA_%d_totals.html",
    },
    "player_advanced_stats": {
        False: "https://www.basketball-reference.com/leagues/NBA_%d_advanced.html",
        True: "https://www.basketball-reference.com/playoffs/NBA_%d_advanced.html",
    },
}
SHOT_PAGE = "https://www.basketball-reference.com/players/%s/%s/shooting/%d"


def season_page_url(table: str, season: Column, is_playoff: Column) -> Column:
    pages = SEASON_PAGES[table]
    return F.when(is_playoff, F.format_string(pages[True], season)).otherwise(
        F.format_string(pages[False], season)
    )


def shot_page_url(player_id: Column, season: Column) -> Column:
    return F.format_string(SHOT_PAGE, F.substring(player_id, 1, 1), player_id, season)


def has_class_token(css_class: Column, token: str) -> Column:
    """Whole-word class test, unlike a plain ``contains``."""
    return F.array_contains(F.split(F.coalesce(css_class, F.lit("")), f"{SPACE}+"), token)


def pixels(declaration: Column) -> Column:
    """``left:244px`` -> 244; the property name is ignored. Null when there is no colon."""
    value = F.get(F.split(declaration, ":"), F.lit(1))
    return F.when(value.isNotNull(), strict_int(F.regexp_replace(value, r"px\z", "")))


def key_hash(raw: Column) -> Column:
    return F.unhex(F.sha2(raw, 256))


def key_hash_hex(raw: Column) -> Column:
    return F.sha2(raw, 256)


# Nanoseconds per unit; micro sign and Greek mu are both written.
UNIT_NS = {
    "h": 3_600_000_000_000,
    "m": 60_000_000_000,
    "s": 1_000_000_000,
    "ms": 1_000_000,
    "us": 1_000,
    "µs": 1_000,
    "μs": 1_000,
    "ns": 1,
}


def duration_ns(text: Column) -> Column:
    """``12.3ms``, ``850µs``, ``1m2.5s`` -> whole nanoseconds."""
    parts = F.regexp_extract_all(text, F.lit("[0-9.]+[a-zµμ]+"), F.lit(0))
    scale = F.create_map(*[F.lit(x) for pair in UNIT_NS.items() for x in pair])

    def nanoseconds(part: Column) -> Column:
        amount = F.regexp_extract(part, "[0-9.]+", 0).try_cast("decimal(28,9)")
        unit = F.regexp_replace(part, "[0-9.]+", "")
        return F.floor(amount * F.try_element_at(scale, unit)).cast("bigint")

    total = F.aggregate(parts, F.lit(0).cast("bigint"), lambda acc, part: acc + nanoseconds(part))
    return F.when(F.size(parts) > 0, total)


def duration_seconds(text: Column) -> Column:
    return duration_ns(text) / F.lit(1e9)
