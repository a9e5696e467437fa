import random

import pytest
from pyspark.sql import functions as F

from courtside.checks.index_queries import TOTALS
from courtside.checks.registry import table
from courtside.operators.countcube import CountCube, insert_deltas, signed, visibility_deltas
from courtside.operators.nameindex import NameIndex
from courtside.operators.paging import deep_slice, page_meta, page_rows
from courtside.operators.rankindex import SMALL_RANGES, STRETCH_ROWS, open_rank_index, range_count, rank_index
from courtside.operators.statquery import StatQuery, matching, order_columns
from courtside.sources.tables import visible
from courtside.workspace import session_setting

ORDER = [("v", True), ("k", False)]


def numbers(spark, count, seed=1):
    rng = random.Random(seed)
    rows = [(i, None if i % 17 == 0 else rng.randrange(8), f"n{i}") for i in range(count)]
    return spark.createDataFrame(rows, "k bigint, v bigint, name string").repartition(5)


def ordered(rows):
    return [tuple(row) for row in rows.orderBy(*order_columns(ORDER)).collect()]


def test_any_page_of_a_stored_order(spark, tmp_path):
    rows = numbers(spark, 700)
    want = ordered(rows)
    path = f"{tmp_path}/index"
    rank_index(rows, ORDER, 700, path, 60)
    index = open_rank_index(spark, path)
    assert index.total == 700 and index.order == ORDER and len(index.ahead) > 6
    for offset, limit in ((0, 1), (0, 700), (59, 3), (350, 200), (699, 5), (700, 5), (10**9, 1), (0, 10**9)):
        assert [tuple(row) for row in index.page(offset, limit).collect()] == want[offset : offset + limit]


def test_a_page_reads_few_ranges_and_has_no_window_or_shuffle_of_rows(spark, tmp_path):
    index = rank_index(numbers(spark, 700), ORDER, 700, f"{tmp_path}/plan", 60)
    text = index.page(350, 20)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in text and "GreaterThanOrEqual(_place" in text and "LessThan(_place" in text


def test_ranges_stay_near_their_bound(spark, tmp_path):
    index = rank_index(numbers(spark, 3000), ORDER, 3000, f"{tmp_path}/bound", 100)
    held = [b - a for a, b in zip(index.ahead, index.ahead[1:])]
    assert sum(held) == 3000 and max(held) <= 300


@pytest.mark.parametrize("offset, limit", [(0, 5), (333, 40), (650, 100), (0, 700), (5, 690), (700, 3)])
@pytest.mark.parametrize("stretch_rows", [3, 50])
def test_deep_slices_without_a_window(spark, offset, limit, stretch_rows):
    rows = numbers(spark, 700)
    page = deep_slice(rows, ORDER, offset, limit, heap_rows=30, stretch_rows=stretch_rows)
    assert [tuple(row) for row in page.select("k", "v", "name").collect()] == ordered(rows)[offset : offset + limit]
    assert "Window" not in page._jdf.queryExecution().executedPlan().toString()


def test_deep_slices_of_equal_rows_end(spark):
    rows = spark.range(300).select(F.lit(1).alias("k"), F.lit(2).alias("v"))
    assert deep_slice(rows, ORDER, 250, 100, heap_rows=10, stretch_rows=50).count() == 50
    assert deep_slice(rows.limit(0), ORDER, 0, 5).count() == 0


def test_small_ranges_do_not_multiply_with_the_table(spark, tmp_path, monkeypatch):
    assert range_count(3_300, 1000) == 4 and range_count(0, 1000) == 1
    assert range_count(33_000_000, 1000) == SMALL_RANGES and range_count(10**9, 1000) == 2000
    assert range_count(10**9, STRETCH_ROWS) == 2000 and range_count(10**9, 10**7) == 100
    monkeypatch.setattr("courtside.operators.rankindex.SMALL_RANGES", 5)
    rows = numbers(spark, 700)
    index = rank_index(rows, ORDER, 700, f"{tmp_path}/few", 10)
    assert len(index.ahead) <= 6 and index.total == rows.count()
    expected = rows.orderBy(*order_columns(ORDER)).offset(320).limit(25).collect()
    assert index.page(320, 25).collect() == expected


def test_empty_order(spark, tmp_path):
    index = rank_index(numbers(spark, 5).limit(0), ORDER, 0, f"{tmp_path}/none")
    assert index.total == 0 and index.page(0, 5).count() == 0


NAMES = ["Ann Lee", "ANNA LEE", "Bo", "", None, "O'Neil & Co", "Élan Özil", "100% _win_", "aaaa", "annan", "a\\b%c", "li lee lee", "漢字かな"]


@pytest.fixture(scope="module")
def named(spark):
    rows = [(i, name, None) for i, name in enumerate(NAMES * 2)]
    return spark.createDataFrame(rows, "id bigint, player_name string, deleted_at timestamp_ntz")


@pytest.mark.parametrize("pattern", ["ann", "ANN", "lee", "nn l", "a", "", "%", "_", "0% _w", "\\b%", "éla", "zzz", "aaaaa", "aaa", "lee lee", "字か", "漢字か", "Il & cO"])
def test_name_index_equals_a_scan(spark, tmp_path, named, pattern):
    index = NameIndex(spark, f"{tmp_path}/names")
    index.refresh(named.where("id < 5"))
    index.refresh(named)
    index.refresh(named)
    found = sorted(row.id for row in index.matching(named, pattern).collect())
    want = visible(named).where(F.col("player_name").isNotNull() & F.lower("player_name").contains(F.lower(F.lit(pattern))))
    assert found == sorted(row.id for row in want.collect())
    assert index.names().count() == len({name for name in NAMES if name is not None})


def test_rows_stay_where_they_are_for_few_names(spark, tmp_path, named):
    index = NameIndex(spark, f"{tmp_path}/few")
    index.refresh(named)
    with session_setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        text = index.matching(named, "a")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_name_index_without_names(spark, tmp_path, named):
    index = NameIndex(spark, f"{tmp_path}/none")
    assert index.matching(named, "ann").count() == 0
    index.refresh(named.limit(0))
    assert index.matching(named, "ann").count() == 0 and index.matching(named, "a").count() == 0


def test_postings_of_one_trigram_are_pushed_down(spark, tmp_path, named):
    index = NameIndex(spark, f"{tmp_path}/plan")
    index.refresh(named)
    assert "EqualTo(trigram,lee)" in index.containing("lee")._jdf.queryExecution().executedPlan().toString()


def test_cube_follows_merges_and_deletions(spark, tmp_path, sf_dir):
    rows = table(spark, sf_dir, TOTALS)
    cube = CountCube(spark, f"{tmp_path}/cube")
    queries = [StatQuery(season=s, team=t, is_playoff=p) for s in (None, 1998, 1900) for t in (None, "T07") for p in (None, True, False)]

    def same(state):
        for q in queries:
            assert cube.page_meta(state, q).collect() == page_meta(state, q).collect()

    empty = rows.limit(0)
    assert cube.total(StatQuery()).first().total == 0
    base, batch = rows.where("season < 1999"), visible(rows.where("season >= 1998"))
    assert cube.apply("load", visibility_deltas(empty, base, TOTALS))
    same(base)
    assert cube.apply("merge", insert_deltas(base, batch, TOTALS)) and not cube.apply("merge", insert_deltas(base, batch, TOTALS))
    merged = base.unionByName(batch.join(base, list(TOTALS.keys), "left_anti"))
    same(merged)
    after = merged.where("team <> 'T07'")
    cube.apply("deletion", visibility_deltas(merged, after, TOTALS))
    same(after)
    cube.apply("back", signed(visible(merged.where("team = 'T07'")), 1))
    same(merged)


def test_cube_leaves_filters_by_player_to_the_rows(spark, tmp_path, sf_dir):
    rows, cube = table(spark, sf_dir, TOTALS), CountCube(spark, f"{tmp_path}/cube")
    for q in (StatQuery(player_id="p0000000042"), StatQuery(name_contains="4"), StatQuery(player_name="Player 42", season=1998)):
        assert not cube.covers(q) and cube.page_meta(rows, q).collect() == page_meta(rows, q).collect()
        with pytest.raises(ValueError):
            cube.total(q)


def test_large_pages_of_a_table_equal_a_sort(spark, sf_dir):
    rows, q = table(spark, sf_dir, TOTALS), StatQuery(sort_by="assists", page=2, page_size=900)
    found = page_rows(rows, TOTALS, q, heap_rows=100).select(*TOTALS.keys).collect()
    want = matching(rows, q).orderBy(*order_columns(q.order(TOTALS))).offset(900).limit(900).select(*TOTALS.keys).collect()
    assert found == want
