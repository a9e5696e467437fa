"""Every registered query next to its SQL, at the smallest scale."""

import pytest

import __spark_entry__ as entry
from compare import check, connect


@pytest.fixture(scope="module")
def db(sf_dir):
    return connect(sf_dir)


# The training-data queries have tests of their own.
@pytest.mark.parametrize("name", [n for n in entry.queries() if n not in entry.LLM_QUERIES])
def test_query_equals_sql(spark, db, sf_dir, name):
    problem = check(spark, db, name, entry.queries()[name], entry.oracle_sql().get(name), sf_dir)
    if problem and problem.startswith("EMPTY"):
        problem = None  # the smallest scale has no rows for some filters
    assert problem is None, problem


def test_entry_has_rows(spark):
    rows = entry.entry(spark)
    assert rows.count() == 20 and rows.columns[-2:] == ["total", "pages"]


def test_sql_keys_are_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())
