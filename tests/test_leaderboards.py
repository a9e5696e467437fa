import json
import os
import random

import pytest
from pyspark.sql import functions as F

from courtside.operators.paging import (
    deep_slice,
    numbered_page,
    page_after,
    page_envelope,
    page_meta,
    page_pieces,
    page_rows,
    page_with_meta,
    write_page,
)
from courtside.operators.statquery import StatQuery, matching, response_rows
from courtside.schemas import ADVANCED, SHOTS, TOTALS


@pytest.fixture(scope="module")
def rows(spark):
    """Few distinct values, one of them on a third of all rows, so that ties are everywhere."""
    n = F.col("id")
    data = spark.range(3000).select(
        F.format_string("p%05d", n).alias("player_id"),
        (1995 + n % 3).alias("season"),
        F.format_string("T%d", n % 4).alias("team"),
        (n % 2 == 0).alias("is_playoff"),
        F.when(n % 3 == 0, 50).otherwise(n % 17).cast("bigint").alias("points"),
        F.when(n % 5 == 0, F.lit("Anthony Davis_1")).otherwise(F.concat(F.lit("P "), n)).alias("player_name"),
        F.when(n % 10 == 9, F.lit("2024-01-01").cast("timestamp_ntz")).alias("deleted_at"),
    )
    data = data.cache()
    data.count()
    return data


def ordered(rows, query):
    picked = [r for r in rows.collect() if r.deleted_at is None]
    column, down = query.order(TOTALS)[0]
    keys = [k for k in TOTALS.keys if k != column]
    picked.sort(key=lambda r: tuple(getattr(r, k) for k in keys))
    picked.sort(key=lambda r: getattr(r, column), reverse=down)
    return picked


def test_params_are_read_leniently():
    q = StatQuery.from_params(
        {"playerId": "", "player_id": "x", "season": "abc", "page": "-", "pageSize": "5", "isPlayoff": "maybe", "sortBy": "?"}
    )
    assert q == StatQuery(player_id="x", is_playoff=False, page_size=5, sort_by="?")
    assert StatQuery.from_params({"playerId": "a", "player_id": "b"}).player_id == "a"
    assert StatQuery.from_params({"isPlayoff": ""}).is_playoff is None
    assert StatQuery.from_params({"isPlayoff": "T", "ascending": "1"}) == StatQuery(is_playoff=True, ascending=True)
    assert StatQuery.from_params({"player_id": "b", "team": "c"}, aliases=False) == StatQuery()
    assert StatQuery.from_params({"season": "0"}).season is None
    assert StatQuery.from_params({"season": "99999999999999999999"}).season is None


def test_bad_page_size_is_refused():
    for size in (0, -3):
        with pytest.raises(ValueError):
            StatQuery(page_size=size)


def test_sort_whitelist():
    assert TOTALS.sort_column("totalRb") == "total_rb"
    assert TOTALS.sort_column("total_rb") == "points"
    assert TOTALS.sort_column("blocks") == "points"
    assert TOTALS.sort_column("blocks", extended=True) == "blocks"
    assert ADVANCED.sort_column("vorp; drop table x") == "win_shares"


@pytest.mark.parametrize("ascending", [False, True])
@pytest.mark.parametrize("sort", ["points", "team", "playerId"])
def test_pages_join_to_the_full_order(rows, sort, ascending):
    size, seen = 700, []
    for page in range(1, 6):
        q = StatQuery(sort_by=sort, ascending=ascending, page=page, page_size=size)
        seen += page_rows(rows, TOTALS, q).collect()
    assert seen == ordered(rows, StatQuery(sort_by=sort, ascending=ascending))
    assert page_meta(rows, StatQuery(page_size=size)).first().asDict() == {
        "total": 2700, "page": 1, "pageSize": size, "pages": 4,
    }


def test_deep_pages_equal_the_full_order(rows):
    rng = random.Random(5)
    cases = [("points", False, [899, 2690, 10**12]), ("points", True, [rng.randrange(2700)]), ("playerId", False, [2700])]
    for sort, ascending, offsets in cases:
        q = StatQuery(sort_by=sort, ascending=ascending)
        expected, found = ordered(rows, q), matching(rows, q)
        for offset in offsets:
            got = deep_slice(found, q.order(TOTALS), offset, 25, heap_rows=60).collect()
            assert got == expected[offset : offset + 25]


def test_next_page_by_boundary(rows):
    for sort in ("points", "team"):
        q = StatQuery(sort_by=sort, page_size=300)
        expected, boundary, seen = ordered(rows, q), None, []
        names = [c for c, _ in q.order(TOTALS)]
        page = page_rows(rows, TOTALS, q).collect()
        while page:
            seen += page
            boundary = tuple(page[-1][c] for c in names)
            page = page_after(rows, TOTALS, q, boundary).collect()
        assert seen == expected


def test_filters(rows):
    assert matching(rows, StatQuery(name_contains="davis")).count() == 600
    assert matching(rows, StatQuery(name_contains="s_1")).count() == 600
    assert matching(rows, StatQuery(name_contains="%")).count() == 0
    assert matching(rows, StatQuery(season=1995, is_playoff=True, team="T0")).count() == len(
        [r for r in rows.collect() if r.deleted_at is None and r.season == 1995 and r.is_playoff and r.team == "T0"]
    )


@pytest.mark.parametrize("page, size", [(1, 20), (1, 10**7), (2, 1000), (3, 1250), (28, 100), (10**6, 20)])
def test_one_document_whatever_its_pieces(rows, page, size):
    q = StatQuery(page=page, page_size=size)
    whole = page_envelope(rows, TOTALS, q).collect()
    assert len(whole) == 1
    document = json.loads(whole[0].envelope)
    assert document["pagination"] == {"total": 2700, "page": page, "pageSize": size, "pages": -(-2700 // size)}
    expected = ordered(rows, q)[q.offset : q.offset + size]
    assert [row["playerId"] for row in document["data"]] == [row.player_id for row in expected]
    if expected:
        assert set(document["data"][0]) == {"playerId", "season", "team", "isPlayoff", "points", "playerName", "DeletedAt"}
    pieces = page_pieces(rows, TOTALS, q, piece_rows=100).collect()
    assert [row.piece for row in pieces] == list(range(max(1, -(-len(expected) // 100))))
    assert "".join(row.envelope for row in pieces) == whole[0].envelope


def test_numbered_pages_of_any_depth(rows):
    for q in (StatQuery(page=2, page_size=900), StatQuery(page=40, page_size=60), StatQuery(page=10**6)):
        page = numbered_page(rows, TOTALS, q, heap_rows=50).collect()
        assert [row._number for row in page] == list(range(len(page)))
        assert [row[: len(rows.columns)] for row in page] == [tuple(row) for row in ordered(rows, q)[q.offset : q.offset + q.page_size]]


def test_a_page_written_in_parts_is_one_document(rows, tmp_path):
    write_page(rows, TOTALS, StatQuery(page_size=2000), f"{tmp_path}/page")
    parts = sorted(name for name in os.listdir(f"{tmp_path}/page") if name.startswith("part-"))
    document = json.loads("".join(open(f"{tmp_path}/page/{name}", encoding="utf-8").read() for name in parts))
    assert [row["playerId"] for row in document["data"]] == [row.player_id for row in ordered(rows, StatQuery())[:2000]]


def test_large_pages_and_ties_end(rows):
    q = StatQuery(sort_by="points", page=2, page_size=1100)
    expected = ordered(rows, q)
    assert page_rows(rows, TOTALS, q, heap_rows=50).collect() == expected[1100:2200]
    one = rows.limit(1)
    tied = one
    for _ in range(8):
        tied = tied.unionByName(tied)
    assert page_rows(tied, TOTALS, StatQuery(page=3, page_size=100), heap_rows=20).count() == min(56, 100) or one.isEmpty()


def test_an_empty_page_keeps_its_numbers(rows):
    got = page_with_meta(rows, TOTALS, StatQuery(page=10**6)).collect()
    assert len(got) == 1 and got[0].total == 2700 and got[0].pages == 135 and got[0].player_id is None


def test_response_names(spark):
    shown = response_rows(spark.createDataFrame([], SHOTS.schema), SHOTS, with_audit=True)
    assert shown.columns[:2] == ["playerId", "season"] and shown.columns[-1] == "DeletedAt"
    assert len(TOTALS.response_names) == 33 and len(ADVANCED.response_names) == 30
    assert len(TOTALS.updates) == 29 and len(ADVANCED.updates) == 26 and len(SHOTS.updates) == 9
