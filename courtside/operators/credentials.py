"""Hashed, revocable credentials: mint, revoke, and checks of request keys."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from courtside.functions.text import key_hash
from courtside.sources.tables import visible


def mint(raw_keys: DataFrame, stamp: datetime) -> DataFrame:
    """(id, raw, label) -> credential rows. Only the hash is kept."""
    return raw_keys.select(
        "id",
        key_hash(F.col("raw")).alias("hash"),
        "label",
        F.lit(False).alias("revoked"),
        F.lit(stamp).cast("timestamp_ntz").alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("revoked_at"),
    )


def revoke(credentials: DataFrame, ids: DataFrame) -> DataFrame:
    """Set ``revoked`` on the listed ids; an unknown id changes nothing."""
    listed = ids.select("id").distinct().withColumn("_listed", F.lit(True))
    joined = credentials.join(listed, "id", "left")
    return joined.withColumn(
        "revoked", F.col("revoked") | F.coalesce(F.col("_listed"), F.lit(False))
    ).select(*credentials.columns)


def active(credentials: DataFrame) -> DataFrame:
    return visible(credentials, "revoked_at").filter(~F.col("revoked"))


def authorised(requests: DataFrame, credentials: DataFrame) -> DataFrame:
    """Requests whose ``hash`` belongs to an active credential."""
    return requests.join(active(credentials).select("hash"), "hash", "left_semi")


def rejected(requests: DataFrame, credentials: DataFrame) -> DataFrame:
    """Requests with an unknown, revoked or missing key."""
    return requests.join(active(credentials).select("hash"), "hash", "left_anti")


def with_key_id(requests: DataFrame, credentials: DataFrame) -> DataFrame:
    """Requests with the id of the active credential, null when there is none."""
    first = active(credentials).groupBy("hash").agg(F.min("id").alias("api_key_id"))
    return requests.join(first, "hash", "left")
