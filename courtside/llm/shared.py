"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

# Words of the contracts that split at ASCII white space.
SPACED_WORD = re.compile(r"[^\x20\x09-\x0D]+")

def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(rows: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes to be no column of ``rows``."""
    taken = {column.lower() for column in rows.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chunks(batch: pa.RecordBatch, column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch holding about ``limit`` bytes of ``column`` each; one row at least."""
    offsets = batch.column(column).buffers()[1]
    if batch.num_rows == 0 or offsets is None:
        return
    sizes = pc.binary_length(batch.column(column)).to_pylist()
    start = held = 0
    for row, size in enumerate(sizes):
        if held and held + (size or 0) > limit:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size or 0
    yield batch.slice(start)
