"""The corpus pipeline: documents in, encoded clean documents out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written to the shared folder
as Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from courtside.llm import decontam, linededup, pieces, quality, simhash
from courtside.llm.shared import source
from courtside.workspace import staged

STAGES = [
    ("quality_rules", quality.stage),
    ("line_dedup", linededup.stage),
    ("simhash_near_dedup", simhash.stage),
    ("decontamination", decontam.stage),
    ("sentencepiece", pieces.stage),
]

# Learned rules, edit similarity and Viterbi paths have no SQL form; tests use brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = source(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
