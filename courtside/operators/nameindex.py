"""Names that contain a text, found by trigram postings instead of a scan of the table.

The index holds each distinct name once, and for each run of three characters of its lower-cased form a posting
(trigram, name), sorted by both, so that a scan of one trigram reads few row groups and a trigram that
most names hold is spread over many files. A search takes the postings of the rarest trigram of the pattern, keeps
the names that the next rarest hold too, and verifies the rest by the containment itself. Patterns without a
trigram are matched against the distinct names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from courtside.operators.statquery import name_contains
from courtside.sources.tables import visible
from courtside.workspace import create_once, names_in, staged

# Trigrams of a pattern that are intersected before names are verified.
INTERSECTED = 3
# Up to so many found names go to every task, whatever size Spark expects; more meet the rows by a shuffle of both.
BROADCAST_NAMES = 2_000_000


def trigrams(name: Column) -> Column:
    """The distinct runs of three characters of the lower-cased text."""
    low = F.lower(name)
    starts = F.when(F.length(low) >= 3, F.sequence(F.lit(1), F.length(low) - 2)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda at: F.substring(low, at, F.lit(3))))


@dataclass
class NameIndex:
    """Parts below ``path``, one per refresh; a part counts once its marker is there."""

    spark: SparkSession
    path: str

    def _parts(self) -> list[str]:
        return sorted(name.removesuffix(".done") for name in names_in(self.spark, self.path) if name.endswith(".done"))

    def _read(self, kind: str, schema: str) -> DataFrame:
        parts = [f"{self.path}/{part}/{kind}" for part in self._parts()]
        return self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)

    def names(self) -> DataFrame:
        return self._read("names", "player_name string")

    def postings(self) -> DataFrame:
        return self._read("postings", "trigram string, player_name string")

    def sizes(self) -> DataFrame:
        """How many names hold each trigram."""
        return self._read("sizes", "trigram string, held bigint").groupBy("trigram").agg(F.sum("held").alias("held"))

    def refresh(self, rows: DataFrame, files: int = 8) -> None:
        """Adds the names of ``rows`` that the index does not hold yet; again with the same rows, nothing."""
        fresh = rows.where(F.col("player_name").isNotNull()).select("player_name").distinct()
        fresh = fresh.join(self.names(), "player_name", "left_anti")
        part = f"part-{len(self._parts()):05d}"
        folder = f"{self.path}/{part}"
        fresh.sortWithinPartitions("player_name").write.mode("overwrite").parquet(f"{folder}/names")
        added = self.spark.read.schema("player_name string").parquet(f"{folder}/names")
        postings = added.select(F.explode(trigrams(F.col("player_name"))).alias("trigram"), "player_name")
        dealt = postings.repartitionByRange(files, "trigram", "player_name").sortWithinPartitions("trigram", "player_name")
        dealt.write.mode("overwrite").parquet(f"{folder}/postings")
        stored = self.spark.read.schema("trigram string, player_name string").parquet(f"{folder}/postings")
        stored.groupBy("trigram").agg(F.count(F.lit(1)).alias("held")).write.mode("overwrite").parquet(f"{folder}/sizes")
        create_once(self.spark, f"{self.path}/{part}.done", "")

    def _rarest(self, pattern: str) -> list[str] | None:
        """The pattern's trigrams from the rarest on; None if a name cannot hold them all."""
        wanted = self.spark.range(1).select(F.explode(trigrams(F.lit(pattern))).alias("trigram"))
        found = wanted.join(self.sizes(), "trigram", "left").orderBy("held", "trigram").collect()
        if any(row.held is None for row in found):
            return None
        return [row.trigram for row in found]

    def containing(self, pattern: str) -> DataFrame:
        """(player_name): the distinct names that contain ``pattern``, whatever the case; % and _ are literal."""
        rarest = self._rarest(pattern)
        if rarest is None:
            return self.names().limit(0)
        if not rarest:
            return self.names().where(name_contains(pattern))
        postings = self.postings()
        held = [postings.where(F.col("trigram") == trigram).select("player_name") for trigram in rarest[:INTERSECTED]]
        names = held[0]
        for more in held[1:]:
            names = names.join(more, "player_name", "left_semi")
        return names.where(name_contains(pattern))

    def matching(self, rows: DataFrame, pattern: str) -> DataFrame:
        """Visible rows whose name contains ``pattern``. Names meet rows by equality; they are found first, since no
        estimate tells how few they are, and a broadcast keeps the rows where they lie."""
        found = staged(self.containing(pattern), "names-found")
        if found.count() <= BROADCAST_NAMES:
            found = F.broadcast(found)
        return visible(rows).join(found, "player_name", "left_semi")
