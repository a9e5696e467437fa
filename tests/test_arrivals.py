"""What arrives on a stream is written and read by many tasks, and its results do not depend on that."""

from pathlib import Path

import __spark_entry__ as entry
from courtside.checks import feeds


def arrived(spark, label, folder):
    newest = max(Path(spark.conf.get("spark.checkpoint.dir")).glob(f"courtside-{label}-*"), key=lambda path: path.stat().st_ctime_ns)
    return list((newest / folder).glob("*.parquet"))


def test_pages_arrive_in_many_files_and_two_micro_batches(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(feeds, "PAGES_PER_TASK", 20)
    found = entry.queries()["stream_ingest_totals"](spark, sf_dir)
    files = arrived(spark, "stream-ingest", "pages")
    assert len(files) > 4
    batches = files[0].parent.parent / "checkpoint/commits"
    assert sorted(path.name for path in batches.iterdir() if path.name.isdigit()) == ["0", "1"]
    whole = entry.queries()["ingest_totals"](spark, sf_dir)
    assert sorted(map(str, found.collect())) == sorted(map(str, whole.collect()))


def test_late_rows_do_not_depend_on_files(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(6).write.parquet(f"{tmp_path}/events.parquet")
    query = entry.queries()["stream_late_rows"]
    parted = query(spark, str(tmp_path)).collect()
    assert len(arrived(spark, "stream-late", "arriving")) > 3
    assert parted == query(spark, sf_dir).collect() and parted[0].dropped > 0
