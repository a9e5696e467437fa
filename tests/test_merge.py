from datetime import datetime

import pytest
from pyspark.sql import functions as F

from courtside.operators.keyedtable import KeyedTable
from courtside.operators.merge import DuplicateKeyError, duplicate_keys, merge_ranges, merge_rows, split_duplicate_batches, with_audit
from courtside.operators.statquery import StatQuery
from courtside.schemas import SHOTS

STAMP, LATER = datetime(2024, 1, 1), datetime(2024, 2, 1)


def shots(spark, ids, score=1, season=None):
    n = F.col("id")
    values = {
        "player_id": F.format_string("p%d", n % 7), "season": F.lit(season) if season else 2020 + n % 3,
        "date": F.lit("Jan 1,2024"), "qtr": F.lit("1st Qtr"), "time_remaining": F.lit("1:00"), "top": n,
        "left": F.lit(0), "player_name": F.lit("x"), "result": F.lit(True), "shot_type": F.lit("2-pointer"),
        "distance_ft": F.lit(1), "lead": F.lit(True), "team_score": F.lit(score), "opponent_team_score": F.lit(0),
        "opponent": F.lit("o"), "team": F.lit("t"),
    }
    rows = spark.createDataFrame([(i,) for i in ids], "id bigint")
    return rows.select(*[values[c].cast(SHOTS.types[c]).alias(c) for c in SHOTS.names])


def content(rows, *more):
    return sorted((r.player_id, r.season, r.top, r.team_score, *[r[m] for m in more]) for r in rows.collect())


@pytest.fixture
def store(spark, tmp_path):
    return KeyedTable(spark, f"file://{tmp_path}/shots", SHOTS)


@pytest.mark.parametrize("small", [False, True])
def test_merge_laws(spark, small):
    base = with_audit(shots(spark, range(20)), STAMP)
    base = base.withColumn("deleted_at", F.when(F.col("top") == 3, F.col("created_at")))
    delta = with_audit(shots(spark, range(15, 30), score=9), LATER)
    once = merge_rows(base, delta, SHOTS, small)
    assert content(merge_rows(once, delta, SHOTS, small), "created_at") == content(once, "created_at")
    assert content(merge_rows(base, delta.limit(0), SHOTS, small)) == content(base)
    assert once.count() == 30
    found = {r.top: r for r in once.collect()}
    assert found[16].team_score == 9 and found[16].created_at == found[16].updated_at == STAMP
    assert found[29].created_at == LATER and found[2].team_score == 1
    again = merge_rows(once, with_audit(shots(spark, [3], score=5), LATER), SHOTS, small)
    hidden = {r.top: r for r in again.collect()}[3]
    assert hidden.team_score == 5 and hidden.deleted_at is not None


def test_partitions_beyond_a_small_batch_are_not_joined(spark):
    base = with_audit(shots(spark, range(30)).withColumn("season", F.when(F.col("top") != 4, F.col("season"))), STAMP)
    delta = with_audit(shots(spark, range(25, 40), score=7, season=2021), LATER)
    merged = merge_rows(base, delta, SHOTS, small_batch=True)
    assert "NOT coalesce" in merged._jdf.queryExecution().analyzed().toString()
    assert sorted(map(str, merged.collect())) == sorted(map(str, merge_rows(base, delta, SHOTS).collect()))


def test_stored_table_commits(spark, store):
    assert store.version() == 0 and store.read().count() == 0
    assert store.upsert(shots(spark, range(30)), STAMP) == 1
    before = {tuple(r)[:2]: r.data_commit for r in store.partitions().collect()}
    assert store.upsert(shots(spark, range(25, 40), score=7, season=2021), LATER) == 2
    after = {tuple(r)[:2]: r.data_commit for r in store.partitions().collect()}
    untouched = [key for key in before if after[key] == 1]
    assert untouched and all(key[0] != 2021 or after[key] == before[key] for key in untouched)
    old = content(shots(spark, range(30)))
    assert content(store.read(1)) == old
    merged = {(r[0], r[1], r[2]): r for r in old}
    merged |= {(r[0], r[1], r[2]): r for r in content(shots(spark, range(25, 40), score=7, season=2021))}
    assert content(store.read()) == sorted(merged.values())


def test_replayed_commit_changes_nothing(spark, store):
    store.upsert(shots(spark, range(5)), STAMP, commit=1)
    store.upsert(shots(spark, range(5), score=8), STAMP, commit=2)
    assert store.upsert(shots(spark, range(5), score=4), STAMP, commit=1) == 2
    assert {r.team_score for r in store.read().collect()} == {8}


def test_duplicate_key_writes_nothing(spark, store):
    store.upsert(shots(spark, range(5)), STAMP)
    twice = shots(spark, [1], score=2).unionByName(shots(spark, [1], score=3))
    with pytest.raises(DuplicateKeyError):
        store.upsert(twice, STAMP)
    assert store.version() == 1
    store.upsert(twice, STAMP, on_duplicate="last", order=["team_score"])
    assert {r.top: r.team_score for r in store.read().collect()}[1] == 3


def test_empty_batch_writes_nothing(spark, store):
    assert store.upsert(shots(spark, []), STAMP) == 0
    store.upsert(shots(spark, [1]), STAMP)
    assert store.upsert(shots(spark, []), STAMP) == 1


def test_batches_with_a_repeated_key_are_refused_whole(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a"), (3, "c")], "batch int, k string")
    clean, refused = split_duplicate_batches(rows, "batch", ["k"])
    assert sorted(map(tuple, clean.collect())) == [(1, "a"), (1, "b"), (3, "c")]
    assert [r.batch for r in refused.collect()] == [2]


def test_the_second_of_two_writers_merges_again(spark, store, monkeypatch):
    store.upsert(shots(spark, range(5)), STAMP)
    other = KeyedTable(spark, store.root, SHOTS)
    real, waiting = KeyedTable._places, [True]

    def places(self, version):
        found = real(self, version)
        if self is store and waiting:
            waiting.clear()
            other.upsert(shots(spark, [50], score=2), STAMP)  # comes in between reading and publishing
        return found

    monkeypatch.setattr(KeyedTable, "_places", places)
    assert store.upsert(shots(spark, [60], score=3), STAMP) == 3
    assert {r.top: r.team_score for r in store.read().collect()} == {**dict.fromkeys(range(5), 1), 50: 2, 60: 3}


def test_incomplete_commits_are_refused(spark, store, monkeypatch):
    from courtside.operators import keyedtable
    from courtside.workspace import create_once

    monkeypatch.setattr(keyedtable, "MARKER_WAIT_S", 0.1)
    store.upsert(shots(spark, range(5)), STAMP)
    assert create_once(spark, f"{store.root}/commits/{2:012d}", "") and not create_once(spark, f"{store.root}/commits/{2:012d}", "x")
    with pytest.raises(keyedtable.IncompleteCommitError):
        store.read()


def test_reads_prune_partitions_and_vacuum_keeps_newest(spark, store):
    for score in (1, 2, 3):
        store.upsert(shots(spark, range(40), score=score), STAMP)
    query = StatQuery(season=2021, player_id="p3")
    pruned = store.read(query=query)
    files = pruned.inputFiles()
    assert files and all("season=2021" in f for f in files) and len({f.split("key_bucket=")[1].split("/")[0] for f in files}) == 1
    assert content(pruned.where("season = 2021 and player_id = 'p3'")) == content(store.read().where("season = 2021 and player_id = 'p3'"))
    assert store.vacuum(keep=1) == 2 and store.version() == 3
    assert {r.team_score for r in store.read().collect()} == {3}
    with pytest.raises(Exception):
        store.read(1).collect()


def test_a_sorted_merge_shuffles_once_and_gives_the_same_rows(spark, monkeypatch):
    from courtside.operators import merge

    monkeypatch.setattr(merge, "ROWS_PER_TASK", 10)
    nameless = F.when(F.col("top") % 10 != 4, F.col("player_id"))
    base = with_audit(shots(spark, range(30)), STAMP).withColumn("player_id", nameless)
    base = base.withColumn("deleted_at", F.when(F.col("top") == 27, F.col("created_at")))
    delta = with_audit(shots(spark, range(20, 40), score=7), LATER).withColumn("player_id", nameless)
    delta = delta.withColumn("team", F.when(F.col("top") != 25, F.col("team")))
    order = ["season", *[k for k in SHOTS.keys if k != "season"]]
    merged = merge_ranges(base, delta, SHOTS, order, 50)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning(season" in plan and merged.rdd.getNumPartitions() > 1
    assert sorted(map(str, merged.collect())) == sorted(map(str, merge_rows(base, delta, SHOTS).collect()))
    assert sorted(map(str, merge_ranges(None, delta, SHOTS, order, 20).collect())) == sorted(map(str, delta.collect()))


def test_bare_keys_are_dealt_out_by_number(spark, monkeypatch):
    from courtside.operators import merge

    monkeypatch.setattr(merge, "KEYS_PER_TASK", 10)
    rows = spark.createDataFrame([(i % 33, None if i % 11 == 0 else "x", "wide") for i in range(35)], "a int, b string, c string")
    found = duplicate_keys(rows, ["a", "b"], total=35)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.rindex("partial_count") < plan.index("Exchange") and "REPARTITION_BY_NUM" in plan
    assert sorted(map(str, found.collect())) == sorted(map(str, duplicate_keys(rows, ["a", "b"]).collect()))
    assert {tuple(r) for r in found.collect()} == {(0, None, 2), (1, "x", 2)}


@pytest.mark.parametrize("rows_per_file", [1, 1000])
def test_new_partitions_of_an_ordered_batch_are_written_where_they_lie(spark, store, monkeypatch, rows_per_file):
    from courtside.operators import keyedtable

    given, real = [], keyedtable.merge_ranges
    monkeypatch.setattr(keyedtable, "ROWS_PER_FILE", rows_per_file)
    monkeypatch.setattr(keyedtable, "merge_ranges", lambda *args: given.append(args[1].count()) or real(*args))
    store.upsert(shots(spark, range(30), season=2020), STAMP)
    batch = shots(spark, range(25, 40), score=7, season=2020).unionByName(shots(spark, range(20), score=8, season=2021))
    assert store.upsert(batch, LATER) == 2
    assert given == ([15] if rows_per_file == 1 else [30, 35])
    found = {(r.season, r.top): (r.team_score, r.created_at) for r in store.read().collect()}
    assert store.read().count() == len(found) == 60
    assert found == {
        **{(2020, i): (1 if i < 25 else 7, STAMP if i < 30 else LATER) for i in range(40)},
        **{(2021, i): (8, LATER) for i in range(20)},
    }
