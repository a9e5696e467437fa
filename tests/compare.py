"""Runs registered queries next to their SQL: row count, columns, types and values."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return db


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return repr(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


_TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp_ntz", "DATE": "date", "BLOB": "binary",
}


def check(spark, db, name, run, sql, sf_dir) -> str | None:
    """None when equal, else what differs."""
    found = run(spark, sf_dir)
    spark_rows = found.collect()
    if sql is None:
        return None if found.columns else "no columns"
    result = db.execute(sql)
    names = [c[0] for c in result.description]
    types = {c[0]: str(c[1]) for c in result.description}
    expected = _rows(names, result.fetchall())
    if sorted(names) != sorted(found.columns):
        return f"columns {sorted(found.columns)} != {sorted(names)}"
    kinds = {f.name: f.dataType.simpleString() for f in found.schema}
    wrong = {n: (kinds[n], types[n]) for n in names if _TYPES.get(types[n], types[n]) != kinds[n]}
    if wrong:
        return f"types (found, expected): {wrong}"
    actual = _rows(found.columns, spark_rows)
    if len(actual) != len(expected):
        return f"{len(actual)} rows, expected {len(expected)}"
    if actual != expected:
        a, e = next((a, e) for a, e in zip(actual, expected) if a != e)
        return f"values, first difference:\n  found    {a}\n  expected {e}"
    return None if actual or name.endswith(("past_end", "literal")) else "EMPTY result on both sides"


if __name__ == "__main__":
    import os

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir, *only = sys.argv[1:]
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    db, sqls, bad = connect(sf_dir), entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if only and not any(part in name for part in only):
            continue
        start = time.time()
        try:
            problem = check(session, db, name, run, sqls.get(name), sf_dir)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:1200]}"
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {time.time() - start:6.2f}s {name} {problem or ''}", flush=True)
    print(f"{bad} failing of {len(entry.queries())}")
