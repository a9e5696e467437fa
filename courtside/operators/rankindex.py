"""Rows numbered in a total order without a window: sorted stretches, each with the count of rows ahead of it.

Rows are dealt into ranges of the order, ``STRETCH_ROWS`` each by Spark's sampled bounds, sorted inside each range and
stored with their place. A row's number is its place plus the rows of the ranges ahead, and what
reaches the driver is one count per range. No row is ever numbered together with more than its range, and a range is an
external sort, so neither an offset nor a page size makes a group larger.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, functions as F

from courtside.operators.statquery import order_columns
from courtside.workspace import create_once, read_small, scratch_path

STRETCH_ROWS = 500_000
# Each range is a task and a file, so smaller ranges than STRETCH_ROWS are made up to this number only.
SMALL_RANGES = 512
# A place is the range's number and, in the lower bits, the row's position there.
_BITS = 33


@dataclass
class RankIndex:
    """A stored copy of rows in order; ``ahead[i]`` is the number of rows in front of range i, the last entry the total."""

    rows: DataFrame
    order: list[tuple[str, bool]]
    ahead: list[int]

    @property
    def total(self) -> int:
        return self.ahead[-1]

    def page(self, offset: int, limit: int, numbered: bool = False) -> DataFrame:
        """Rows ``offset + 1 .. offset + limit`` in order; reads the ranges that hold them and sorts nothing else.

        ``numbered`` adds ``_number``, from 0 on in the page.
        """
        last = min(offset + limit, self.total)
        if offset >= last:
            none = self.rows.withColumn("_number", F.lit(0).cast("bigint")) if numbered else self.rows
            return none.drop("_place").limit(0)
        ranges = range(len(self.ahead) - 1)
        low = next(i for i in ranges if self.ahead[i + 1] > offset)
        high = next(i for i in ranges if self.ahead[i + 1] >= last)
        # Positions in the outer ranges; everything between lies in the page. Both bounds reach the scan.
        first_place = (low << _BITS) + offset - self.ahead[low]
        end_place = (high << _BITS) + last - self.ahead[high]
        found = self.rows.where((F.col("_place") >= first_place) & (F.col("_place") < end_place))
        found = found.orderBy("_place")
        if numbered:
            before = F.array(*[F.lit(self.ahead[i] - offset).cast("bigint") for i in range(low, high + 1)])
            range_ = F.shiftright("_place", _BITS).cast("int")
            found = found.withColumn("_number", F.get(before, range_ - low) + F.col("_place").bitwiseAND((1 << _BITS) - 1))
        return found.drop("_place")


def range_count(total: int, stretch_rows: int) -> int:
    """Ranges of ``stretch_rows``; beyond SMALL_RANGES of them larger ones, of up to STRETCH_ROWS.

    So the number of tasks, files and counts does not grow with the table while its ranges still fit a task.
    """
    asked = -(-total // stretch_rows)
    return max(1, min(asked, max(SMALL_RANGES, -(-total // max(stretch_rows, STRETCH_ROWS)))))


def rank_index(
    rows: DataFrame, order: list[tuple[str, bool]], total: int, path: str | None = None, stretch_rows: int = STRETCH_ROWS
) -> RankIndex:
    """Stores ``rows`` (about ``total`` of them) in ``order``, which has to be total up to equal rows.

    ``stretch_rows`` is the aim for a range; see ``range_count`` for large tables.
    """
    spark = rows.sparkSession
    path = path or scratch_path(spark, "ranked")
    ranges = range_count(total, stretch_rows)
    columns = order_columns(order)
    placed = rows.repartitionByRange(ranges, *columns).sortWithinPartitions(*columns)
    placed = placed.withColumn("_place", F.monotonically_increasing_id())
    placed.write.parquet(f"{path}/rows")
    stored = spark.read.schema(placed.schema).parquet(f"{path}/rows")
    held = dict(stored.groupBy(F.shiftright("_place", _BITS).alias("range")).agg(F.count(F.lit(1))).collect())
    ahead = list(accumulate((held.get(i, 0) for i in range(max(held, default=0) + 1)), initial=0))
    # Written last: an index without it was not finished.
    create_once(spark, f"{path}/index.json", json.dumps({"order": order, "ahead": ahead}))
    return RankIndex(stored, order, ahead)


def open_rank_index(spark: SparkSession, path: str) -> RankIndex:
    """A stored index; any page of it needs no sort of the table and no count."""
    known = json.loads(read_small(spark, f"{path}/index.json"))
    return RankIndex(spark.read.parquet(f"{path}/rows"), [tuple(entry) for entry in known["order"]], known["ahead"])
