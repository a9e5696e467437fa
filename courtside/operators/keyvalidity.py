"""Request keys judged by the time of the request: keys are minted and revoked, and the log of that is kept.

A change is a row (id, hash, kind, at): ``mint`` brings a key's hash, ``revoke`` needs its id only. A request
is authorised if its key was minted at or before its time and not revoked by then, whatever the key table says
when the request is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MINT, REVOKE = "mint", "revoke"
AUTHORISED, REVOKED, UNKNOWN = "authorised", "revoked", "unknown"


def key_changes(credentials: DataFrame) -> DataFrame:
    """The changes behind a credential table with mint times and, where revoked, revocation times."""
    minted = credentials.select("id", "hash", F.lit(MINT).alias("kind"), F.col("created_at").alias("at"))
    ended = credentials.where(F.col("revoked_at").isNotNull()).select(
        "id", "hash", F.lit(REVOKE).alias("kind"), F.col("revoked_at").alias("at")
    )
    return minted.unionByName(ended)


def key_intervals(changes: DataFrame) -> DataFrame:
    """(id, hash, valid_from, valid_to): from the first mint to the first revocation, which is null while there is none.

    Repeated changes add nothing; a revocation without a mint gives no interval.
    """
    at = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("at")))
    ends = changes.groupBy("id").agg(
        F.max(F.when(F.col("kind") == MINT, F.col("hash"))).alias("hash"), at(MINT).alias("valid_from"), at(REVOKE).alias("valid_to")
    )
    return ends.where(F.col("valid_from").isNotNull() & F.col("hash").isNotNull())


def verdict(known: Column, valid: Column) -> Column:
    return F.when(valid, AUTHORISED).when(known, REVOKED).otherwise(UNKNOWN)


def judged(requests: DataFrame, changes: DataFrame) -> DataFrame:
    """Each request with ``verdict`` and the id of its key, null unless authorised.

    Keys meet requests by hash once, their few intervals together, so a request is never repeated; a key with
    many requests is split by Spark's skew join, and a small key table is broadcast by its measured size.
    """
    intervals = key_intervals(changes).select("hash", F.struct("id", "valid_from", "valid_to").alias("span"))
    keys = intervals.groupBy("hash").agg(F.collect_list("span").alias("_spans"))
    begun = F.filter("_spans", lambda span: span["valid_from"] <= F.col("ts"))
    valid = F.filter("_begun", lambda span: span["valid_to"].isNull() | (F.col("ts") < span["valid_to"]))
    met = requests.join(keys, "hash", "left").withColumn("_begun", begun).withColumn("_valid", valid)
    found = lambda name: F.coalesce(F.size(name) > 0, F.lit(False))
    return met.withColumns(
        {"verdict": verdict(found("_begun"), found("_valid")), "api_key_id": F.array_min(F.transform("_valid", lambda span: span["id"]))}
    ).drop("_spans", "_begun", "_valid")
