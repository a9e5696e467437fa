from datetime import datetime, timedelta

import pytest

from courtside.operators import keyvalidity as kv
from courtside.streaming.keychecks import append_judged
from courtside.streaming.live import parquet_stream

CHANGES = "id bigint, hash string, kind string, at timestamp_ntz"
REQUESTS = "request_id bigint, ts timestamp_ntz, hash string"


def at(hours):
    return datetime(2024, 1, 1) + timedelta(hours=hours)


def brute(requests, changes):
    out = {}
    for request_id, ts, hash_ in requests:
        spans = []
        for id_ in {c[0] for c in changes if c[2] == "mint" and c[1] == hash_ and hash_ is not None}:
            begin = min(c[3] for c in changes if c[0] == id_ and c[2] == "mint")
            ends = [c[3] for c in changes if c[0] == id_ and c[2] == "revoke"]
            spans.append((id_, begin, min(ends) if ends else None))
        begun = [s for s in spans if s[1] <= ts]
        valid = [s for s in begun if s[2] is None or ts < s[2]]
        verdict = "authorised" if valid else "revoked" if begun else "unknown"
        out[request_id] = (verdict, min(s[0] for s in valid) if valid else None)
    return out


def test_judged_by_time_with_repeats_nulls_and_new_mints(spark):
    changes = [
        (1, "a", "mint", at(1)), (1, None, "revoke", at(5)), (1, None, "revoke", at(4)), (2, "b", "mint", at(0)), (2, "b", "mint", at(9)),
        (3, "a", "mint", at(8)), (4, None, "revoke", at(2)), (5, "c", "mint", at(6)), (5, "c", "revoke", at(6)),
    ]
    requests = [(i, at(i / 2), h) for i, h in enumerate(["a", "b", "c", "zzz", None] * 5)]
    requests.append((99, at(1), "a"))
    found = kv.judged(spark.createDataFrame(requests, REQUESTS), spark.createDataFrame(changes, CHANGES))
    assert {r.request_id: (r.verdict, r.api_key_id) for r in found.collect()} == brute(requests, changes)
    none = kv.judged(spark.createDataFrame(requests, REQUESTS), spark.createDataFrame([], CHANGES))
    assert {r.verdict for r in none.collect()} == {"unknown"}


@pytest.mark.parametrize("policy", [None, "min"])
def test_a_key_revoked_between_two_batches_rejects_later_requests_only(spark, tmp_path, policy):
    setting = "spark.sql.streaming.multipleWatermarkPolicy"
    if policy:
        spark.conf.set(setting, policy)
    parts = [
        ([(1, at(1), "a"), (2, at(2), "b")], [(1, "a", "mint", at(0)), (2, "b", "mint", at(1.5))]),
        # The revocation of the second batch is of a time between requests of that batch.
        ([(3, at(3), "a"), (4, at(5), "a"), (5, at(5), "b"), (6, at(4), "a")], [(1, None, "revoke", at(4)), (1, None, "revoke", at(4.5)), (2, "b", "mint", at(3))]),
        ([(7, at(7), "a"), (8, at(7), "b"), (9, at(7), None)], [(1, None, "revoke", at(6))]),
        ([(10, at(99), "b")], []),
    ]
    folder = f"{tmp_path}"
    for requests, changes in parts:
        for name, rows, schema in (("requests", requests, REQUESTS), ("changes", changes, CHANGES)):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")
        streams = [parquet_stream(spark, f"{folder}/{name}", spark.createDataFrame([], schema).schema) for name, schema in (("requests", REQUESTS), ("changes", CHANGES))]
        append_judged(*streams, ["request_id", "verdict", "api_key_id"], f"{folder}/judged", f"{folder}/checkpoint", "1 hour").awaitTermination()
    assert spark.conf.get(setting, None) == policy
    spark.conf.unset(setting)
    rows = spark.read.parquet(f"{folder}/judged").collect()
    found = {r.request_id: (r.verdict, r.api_key_id) for r in rows}
    assert len(found) == len(rows)
    want = brute([r for p in parts[:3] for r in p[0]], [c for p in parts for c in p[1]])
    found.pop(10, None)
    assert found == want
