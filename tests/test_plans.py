"""Plan properties that matter at scale."""

import pytest

import __spark_entry__ as entry
from courtside.checks import feeds


def plan(spark, sf_dir, name):
    frame = entry.queries()[name](spark, sf_dir)
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["page_totals_first", "page_totals_third", "sort_advanced_by_per"])
def test_pages_use_a_bounded_heap(spark, sf_dir, name):
    text = plan(spark, sf_dir, name)
    assert "TakeOrderedAndProject" in text and "Exchange" not in text


def test_filters_reach_the_scan(spark, sf_dir):
    text = plan(spark, sf_dir, "page_totals_first")
    assert "PartitionFilters: [isnotnull(season" in text
    text = plan(spark, sf_dir, "shots_filter_both")
    assert "EqualTo(player_id," in text and "PartitionFilters: [isnotnull(season" in text


def test_count_reads_only_filter_columns(spark, sf_dir):
    text = plan(spark, sf_dir, "meta_totals")
    assert "partial_count" in text and "ReadSchema: struct<deleted_at:timestamp_ntz>" in text


def test_last_wins_is_trimmed_before_the_shuffle(spark, sf_dir):
    text = plan(spark, sf_dir, "last_of_duplicates")
    assert text.index("Final") < text.index("Exchange") < text.rindex("Partial")


def test_extraction_has_no_shuffle_of_pages(spark, sf_dir):
    text = plan(spark, sf_dir, "extract_totals_rows")
    after_read = text[: text.index("MapInArrow")]
    assert "Exchange" not in after_read and "SortMergeJoin" not in text


def test_season_tables_are_dealt_out_once(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(feeds, "LINES_PER_TASK", 1000)
    text = feeds.totals(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "rangepartitioning(season" in text


# These run jobs while they are built; their steps are covered by the other queries.
EAGER = ("stream_", "ingest_", "upsert_", "page_totals_deep", "page_totals_large", "cumulative", "table_schemas", "op", "pipeline")


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if not n.startswith(EAGER)))
def test_no_cross_joins_anywhere(spark, sf_dir, name):
    text = plan(spark, sf_dir, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from courtside.workspace import shared_dir

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        session = SimpleNamespace(
            conf=SimpleNamespace(get=lambda key, default: None), sparkContext=SimpleNamespace(master=master)
        )
        with pytest.raises(ValueError):
            shared_dir(session)
