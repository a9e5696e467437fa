from datetime import datetime

import pytest
from pyspark.sql import functions as F

from courtside.checks.write_queries import base_and_delta
from courtside.operators.buckettable import BucketTable, buckets_for
from courtside.operators.merge import DuplicateKeyError, merge_rows, with_audit
from courtside.schemas import TOTALS
from courtside.sources.tables import visible

FIRST, SECOND = datetime(2024, 6, 1), datetime(2024, 6, 2)


@pytest.fixture
def filled(spark, sf_dir, tmp_path):
    _, base, batch = base_and_delta(spark, sf_dir, "totals")
    store = BucketTable(spark, f"bucketed_{tmp_path.name.replace('-', '_')}", f"{tmp_path}/table", TOTALS, 4)
    store.create()
    base = visible(base).select(*TOTALS.names)
    store.upsert(base, FIRST)
    yield store, base, batch
    spark.sql(f"DROP TABLE {store.name}")


def same(found, expected):
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.select(*found.columns).collect()))


def test_merges_equal_the_operator_and_leave_other_partitions(spark, filled):
    store, base, batch = filled
    store.upsert(batch, SECOND)
    same(store.read(), merge_rows(with_audit(base, FIRST), with_audit(batch, SECOND), TOTALS))
    stamps = {(row.season >= 2000, row.created_at) for row in store.read().select("season", "created_at").collect()}
    assert (False, SECOND) not in stamps and (True, SECOND) in stamps


def test_the_target_is_not_shuffled(spark, filled):
    store, _, batch = filled
    merged = store.merged(with_audit(batch, SECOND).where("season = 2000"))
    text = merged._jdf.queryExecution().executedPlan().toString()
    # The one exchange deals out the batch; the scan of the target keeps to its buckets.
    assert text.count("Exchange") == 1 and "REPARTITION_BY_NUM" in text and "SelectedBucketsCount: 4 out of 4" in text
    assert "PartitionFilters: [" in text and "part_season" in text


def test_a_stored_table_is_found_again_and_refuses_repeated_keys(spark, filled):
    store, base, batch = filled
    again = BucketTable(spark, f"{store.name}_again", store.path, TOTALS, 4)
    again.create()
    same(again.read(), store.read())
    spark.sql(f"DROP TABLE {again.name}")
    with pytest.raises(DuplicateKeyError):
        store.upsert(batch.unionByName(batch), SECOND)
    store.upsert(batch.withColumn("points", F.lit(1).cast("bigint")).unionByName(batch), SECOND, "last", ["points"])
    store.upsert(batch.limit(0), SECOND)
    assert store.read().count() == base.select(*TOTALS.keys).unionByName(batch.select(*TOTALS.keys)).distinct().count()


def test_merged_rows_keep_one_file_a_bucket_and_leave_no_table(spark, filled):
    store, _, batch = filled
    store.upsert(batch, SECOND)
    files = spark.table(store.name).select("part_season", "part_is_playoff", F.input_file_name().alias("file")).distinct()
    assert files.groupBy("part_season", "part_is_playoff").count().where(f"count > {store.buckets}").count() == 0
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("merged_")]


def test_buckets_grow_with_the_table():
    assert buckets_for(0) == buckets_for(2_000_000) == 8 and buckets_for(200_000_000) == 800
