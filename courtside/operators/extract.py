"""Pages to table rows and tooltips: one narrow pass, no shuffle.

Each page yields one nested record. Everything after the markup reader is native: rows are
exploded, repeated header rows skipped, malformed rows routed aside, values typed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from courtside.functions.coerce import (
    fields,
    first_nonempty,
    first_nonzero,
    strict_float,
    strict_int,
    trim_space,
)
from courtside.functions.text import has_class_token, pixels
from courtside.schemas import ADVANCED, DOUBLE, LONG, SHOTS, TOTALS, TableSpec
from courtside.sources.markup import parse, shot_tooltips, stat_table

# Fixed values: (table id, wrapper id) by table and season phase.
TABLE_IDS = {
    TOTALS.name: {False: ("totals_stats", None), True: ("totals_stats", None)},
    ADVANCED.name: {
        False: ("advanced", "all_advanced"),
        True: ("advanced_stats", "all_advanced_stats"),
    },
}
CHART_MARK = 'id="div_shot-chart"'
APPENDED_KEY = "player-additional"

_ROW = pa.struct(
    [("row_class", pa.string()), ("cells", pa.list_(pa.string())), ("append_csv", pa.list_(pa.string()))]
)
_TABLE_FIELDS = {
    "status": pa.string(), "message": pa.string(), "headers": pa.list_(pa.string()), "rows": pa.list_(_ROW)
}
_TABLE_DDL = (
    "status string, message string, headers array<string>, "
    "rows array<struct<row_class: string, cells: array<string>, append_csv: array<string>>>"
)
_SHOT_FIELDS = {
    "status": pa.string(),
    "message": pa.string(),
    "player_name": pa.string(),
    "tooltips": pa.list_(pa.struct([("style", pa.string()), ("tip", pa.string())])),
}
_SHOT_DDL = "status string, message string, player_name string, tooltips array<struct<style: string, tip: string>>"


def _read_markup(pages: DataFrame, carried: list[str], reader, fields_: dict, ddl: str) -> DataFrame:
    """Run ``reader(row)`` over every page; ``carried`` columns pass through untouched.

    A page the reader fails on becomes a row of status ``error`` with the message; no page stops the job.
    """
    blank = {name: [] if pa.types.is_list(kind) else None for name, kind in fields_.items()}

    def guarded(row: dict) -> dict:
        try:
            return blank | reader(row)
        except Exception as error:  # whatever a page does to the reader
            return blank | {"status": "error", "message": f"{type(error).__name__}: {error}"[:500]}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [guarded(row) for row in batch.to_pylist()]
            arrays = [batch.column(name) for name in carried]
            arrays += [pa.array([f[name] for f in found], type=t) for name, t in fields_.items()]
            yield pa.RecordBatch.from_arrays(arrays, names=[*carried, *fields_])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*carried).schema)
    return pages.mapInArrow(read, f"{kept}, {ddl}")


def extract_tables(pages: DataFrame, spec: TableSpec) -> DataFrame:
    """(page_id, season, is_playoff, status, headers, rows) for pages joined to their tasks.

    Pages without the table's id never cross into Python: their markup is blanked first.
    """
    ids = TABLE_IDS[spec.name]
    # A page of no known phase reaches the reader, which refuses it.
    marked = F.col("is_playoff").isNull() | F.when(
        F.col("is_playoff"), F.col("html").contains(ids[True][0])
    ).otherwise(F.col("html").contains(ids[False][0]))
    carried = ["page_id", "season", "is_playoff"]
    needed = pages.select(*carried, F.when(marked, F.col("html")).alias("html"))

    def reader(row: dict) -> dict:
        if row["html"] is None:
            return {"status": "no_table", "headers": [], "rows": []}
        return stat_table(row["html"], *ids[row["is_playoff"]])

    return _read_markup(needed, carried, reader, _TABLE_FIELDS, _TABLE_DDL)


def table_rows(extracted: DataFrame, spec: TableSpec) -> DataFrame:
    """One row per body row that is not a repeated header, with key/text pairs.

    ``kind`` is ``malformed`` (more cells than headers), ``no_player`` or ``player``.
    """
    keyed = extracted.withColumn("keys", F.concat("headers", F.array(F.lit(APPENDED_KEY))))
    exploded = keyed.withColumn("places", _places(F.col("keys"), wanted_keys(spec))).select(
        "page_id",
        "season",
        "is_playoff",
        F.size("keys").alias("n_keys"),
        "places",
        F.posexplode("rows").alias("row_idx", "row"),
    )
    cls, cells = F.col("row.row_class"), F.col("row.cells")
    repeated = cls.contains("thead") if spec is TOTALS else has_class_token(cls, "thead")
    given = exploded.filter(~repeated).select(
        "page_id",
        "season",
        "is_playoff",
        "row_idx",
        "n_keys",
        "places",
        F.try_element_at(
            F.filter("row.append_csv", lambda value: value.isNotNull()), F.lit(-1)
        ).alias("player_id"),
        cells.alias("cells"),
    )
    kind = (
        F.when(F.size("cells") > F.col("n_keys"), "malformed")
        .when(F.coalesce("player_id", F.lit("")) == "", "no_player")
        .otherwise("player")
    )
    return given.select(
        "page_id", "season", "is_playoff", "row_idx", kind.alias("kind"), "player_id", "cells", "places"
    )


def wanted_keys(spec: TableSpec) -> dict[str, list[str]]:
    """Page keys to look up, by the kind of column they fill."""
    found: dict[str, list[str]] = {"long": [], "double": [], "text": []}
    for column, keys in spec.page_keys.items():
        kind = _kind(spec, column)
        found[kind] += [key for key in keys if key not in found[kind]]
    return found


def _kind(spec: TableSpec, column: str) -> str:
    return {LONG: "long", DOUBLE: "double"}.get(spec.types[column], "text")


def _places(keys: Column, wanted: dict[str, list[str]]) -> Column:
    """Where each wanted key stands among the headers, worked out once per page.

    A key has one place, or several on pages that repeat it; -1 when it is missing.
    """
    names = F.array(*[F.lit(key) for group in wanted.values() for key in group])
    every = F.sequence(F.lit(0), F.size(keys) - 1)
    several = F.transform(names, lambda name: F.filter(every, lambda i: F.get(keys, i) == name))
    one = F.transform(names, lambda name: F.array((F.array_position(keys, name) - 1).cast("int")))
    return F.when(F.size(F.array_distinct(keys)) < F.size(keys), several).otherwise(one)


def cell_rows(extracted: DataFrame) -> DataFrame:
    """Long view: one row per cell, paired with its header key by position."""
    rows = extracted.select(
        "page_id", "headers", F.posexplode("rows").alias("row_idx", "row")
    )
    cells = rows.select(
        "page_id", "headers", "row_idx", "row", F.posexplode("row.cells").alias("col_idx", "text")
    )
    return cells.select(
        "page_id",
        "row_idx",
        "col_idx",
        F.col("row.row_class").alias("row_class"),
        F.get(F.concat("headers", F.array(F.lit(APPENDED_KEY))), F.col("col_idx")).alias("data_stat"),
        F.get("row.append_csv", F.col("col_idx")).alias("append_csv"),
        trim_space(F.col("text")).alias("text"),
    )


def typed_rows(rows: DataFrame, spec: TableSpec) -> DataFrame:
    """Player rows as typed table columns, driven by the table's page keys.

    Cells are picked and coerced as arrays, one per kind of column, which keeps the
    generated code small enough to be compiled. Of repeated keys the last one that the
    row is long enough to fill counts; a missing cell reads as empty text.
    """
    wanted = wanted_keys(spec)
    players = rows.filter(F.col("kind") == "player")

    def picked(places: Column) -> Column:
        filled = F.filter(places, lambda place: place < F.size("cells"))
        place = F.when(F.size(places) == 1, F.get(places, F.lit(0))).otherwise(F.array_max(filled))
        return trim_space(F.coalesce(F.get("cells", place), F.lit("")))

    def part(kind: str, coerce=None) -> Column:
        start = 1 + sum(len(wanted[k]) for k in list(wanted)[: list(wanted).index(kind)])
        texts = F.slice("texts", F.lit(start), F.lit(len(wanted[kind])))
        return (F.transform(texts, coerce) if coerce else texts).alias(kind)

    kept = [c for c in spec.names if c not in spec.page_keys]
    values = players.select("page_id", *kept, F.transform("places", picked).alias("texts")).select(
        "page_id", *kept, part("long", strict_int), part("double", strict_float), part("text")
    )

    def value(column: str) -> Column:
        if column not in spec.page_keys:
            return F.col(column)
        kind = _kind(spec, column)
        found = [F.get(kind, F.lit(wanted[kind].index(key))) for key in spec.page_keys[column]]
        return first_nonempty(*found) if kind == "text" else first_nonzero(*found)

    return values.select("page_id", *[value(c).alias(c) for c in spec.names])


def extract_shots(pages: DataFrame) -> DataFrame:
    """(page_id, player_id, season, status, player_name, tooltips) per shot-chart page.

    A page whose ``http_status`` is not 200 is not read at all.
    """
    carried = ["page_id", "player_id", "season"]
    fetched = F.coalesce(F.col("http_status"), F.lit(200)) if "http_status" in pages.columns else F.lit(200)
    readable = (fetched == 200) & F.col("html").contains(CHART_MARK)
    needed = pages.select(
        *carried,
        F.when(readable, F.col("html")).alias("html"),
        F.when(fetched == 200, F.lit("no_comment")).otherwise(F.lit("http_error")).alias("unread"),
    )

    def reader(row: dict) -> dict:
        if row["html"] is None:
            return {"status": row["unread"], "player_name": "", "tooltips": []}
        return shot_tooltips(row["html"])

    found = _read_markup(needed, carried, reader, _SHOT_FIELDS, _SHOT_DDL)
    return found.withColumn("player_name", first_nonempty(F.col("player_name"), F.col("player_id")))


def shot_rows(extracted: DataFrame) -> DataFrame:
    """Tooltips parsed into shot columns; ``malformed`` marks texts with missing parts."""
    points = extracted.select(
        "page_id", "player_id", "season", "player_name", F.posexplode("tooltips").alias("idx", "point")
    )
    style = F.split("point.style", ";")
    tip = F.split("point.tip", "<br>")
    parts = points.select(
        "page_id",
        "player_id",
        "season",
        "player_name",
        "idx",
        pixels(F.get(style, F.lit(0))).alias("top"),
        pixels(F.get(style, F.lit(1))).alias("left"),
        F.split(F.get(tip, F.lit(0)), ", ", 3).alias("header"),
        F.split(F.get(tip, F.lit(1)), ",", 2).alias("period"),
        fields(F.get(tip, F.lit(2))).alias("outcome"),
        F.split(F.try_element_at(fields(F.get(tip, F.lit(3))), F.lit(-1)), "-").alias("score"),
    )
    game = F.get("header", F.lit(2))
    at, vs = F.split(game, " at ", 2), F.split(game, " vs ", 2)

    def side(i: int) -> Column:
        return (
            F.when(F.size(at) == 2, F.get(at, F.lit(i)))
            .when(F.size(vs) == 2, F.get(vs, F.lit(i)))
            .otherwise("")
        )

    shots = parts.select(
        "page_id",
        "idx",
        "player_id",
        "season",
        F.concat(F.get("header", F.lit(0)), F.lit(","), F.get("header", F.lit(1))).alias("date"),
        F.get("period", F.lit(0)).alias("qtr"),
        F.get(fields(F.get("period", F.lit(1))), F.lit(0)).alias("time_remaining"),
        "top",
        "left",
        "player_name",
        (F.get("outcome", F.lit(0)) == "Made").alias("result"),
        F.get("outcome", F.lit(1)).alias("shot_type"),
        strict_int(F.try_element_at("outcome", F.lit(-2))).alias("distance_ft"),
        strict_int(F.get("score", F.lit(0))).alias("team_score"),
        F.when(F.get("score", F.lit(1)).isNotNull(), strict_int(F.get("score", F.lit(1)))).alias(
            "opponent_team_score"
        ),
        side(1).alias("opponent"),
        side(0).alias("team"),
    )
    needed = ["date", "time_remaining", "top", "left", "result", "shot_type", "opponent_team_score"]
    whole = F.lit(True)
    for column in needed:
        whole = whole & F.col(column).isNotNull()
    return shots.withColumn("lead", F.col("team_score") > F.col("opponent_team_score")).withColumn(
        "kind", F.when(whole, "shot").otherwise("malformed")
    )


def typed_shots(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("kind") == "shot").select("page_id", *SHOTS.names)


def shot_date(date_text: Column) -> Column:
    """Calendar date of the stored text, null when it is not one."""
    return F.try_to_date(date_text, "MMM d,yyyy")


def markup_counts(pages: DataFrame, tags: list[str]) -> DataFrame:
    """(page_id, status, comments, and per tag the number of elements) as the reader sees every page."""

    def reader(row: dict) -> dict:
        root = parse(row["html"] or "")
        found = Counter(element.tag for element in root.walk())
        return {"status": "ok", "comments": sum(1 for _ in root.comments())} | {f"n_{tag}": found[tag] for tag in tags}

    names = ["comments", *[f"n_{tag}" for tag in tags]]
    fields_ = {"status": pa.string(), "message": pa.string()} | {name: pa.int64() for name in names}
    ddl = "status string, message string, " + ", ".join(f"{name} bigint" for name in names)
    read = _read_markup(pages.select("page_id", "html"), ["page_id"], reader, fields_, ddl)
    return read.select("page_id", "status", *names)


def comment_bodies(html: Column) -> Column:
    """All comment texts of a page, natively."""
    return F.regexp_extract_all(html, F.lit("(?s)<!--(.*?)-->"), F.lit(1))
