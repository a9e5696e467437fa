import pytest
from pyspark.sql import functions as F

from courtside.functions import (
    duration_ns,
    fields,
    first_nonempty,
    first_nonzero,
    has_class_token,
    lookup,
    pixels,
    strict_float,
    strict_int,
    trim_space,
    zip_last_wins,
)


def evaluate(spark, column, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.select(column(F.col("v")).alias("x"), "i").orderBy("i").collect()]


def test_strict_int(spark):
    cases = {
        "12": 12, "+7": 7, "-3": -3, "007": 7, "": 0, " 12": 0, "12 ": 0, "1.0": 0, "12\n": 0, "1_0": 0,
        "abc": 0, "+": 0, "٣": 0, "9223372036854775807": 2**63 - 1, "9223372036854775808": 2**63 - 1,
        "-9223372036854775809": -(2**63), "000000000000000000000000000005": 5,
    }
    assert evaluate(spark, strict_int, list(cases)) == list(cases.values())


def test_strict_float(spark):
    cases = {
        ".512": 0.512, "1.": 1.0, "-0.5": -0.5, "2e3": 2000.0, "1E-2": 0.01, "": 0.0, " 1": 0.0, "1.5d": 0.0,
        "2f": 0.0, "1_0": 0.0, "NaN": 0.0, "Inf": 0.0, "0x1p2": 0.0, ".": 0.0, "1e400": float("inf"),
        "-1e400": float("-inf"),
    }
    assert evaluate(spark, strict_float, list(cases)) == list(cases.values())


def test_trim_and_fields(spark):
    assert evaluate(spark, trim_space, ["  a b \t\n", "　", "x"]) == ["a b", "", "x"]
    assert evaluate(spark, fields, [" a b\t\tc ", "", " "]) == [["a", "b", "c"], [], []]


def test_fallbacks(spark):
    rows = spark.createDataFrame([(0, 5, "", "b"), (3, 5, "a", "b"), (0, 0, "", "")], "p int, q int, s string, t string")
    found = rows.select(first_nonzero(F.col("p"), F.col("q")), first_nonempty(F.col("s"), F.col("t"))).collect()
    assert [tuple(r) for r in found] == [(5, "b"), (3, "a"), (0, "")]


@pytest.mark.parametrize(
    "keys, cells, expected",
    [
        (["a", "b"], ["1", "2"], {"a": "1", "b": "2"}),
        (["a", "b", "a"], ["1", "2", "3"], {"a": "3", "b": "2"}),
        (["a", "b", "a"], ["1", "2"], {"a": "1", "b": "2"}),
        (["a", "b"], [], {}),
    ],
)
def test_zip_last_wins(spark, keys, cells, expected):
    rows = spark.createDataFrame([(keys, cells)], "k array<string>, c array<string>")
    row = rows.select(zip_last_wins(F.col("k"), F.col("c")).alias("m")).select("m", lookup(F.col("m"), "zz")).first()
    assert row[0] == expected and row[1] == ""


def test_pixels_and_classes(spark):
    assert evaluate(spark, pixels, ["left:244px", "x:7", "left: 244px", "244px", "a:1:2"]) == [244, 7, 0, None, 1]
    assert evaluate(spark, lambda c: has_class_token(c, "thead"), ["thead", "a thead", "xthead", ""]) == [
        True, True, False, False,
    ]


def test_durations(spark):
    cases = {
        "12.3ms": 12_300_000, "1.2s": 1_200_000_000, "850µs": 850_000, "850μs": 850_000, "1m2.5s": 62_500_000_000,
        "1h0m0.5s": 3_600_500_000_000, "100ns": 100, "0s": 0, "soon": None, "5xs": None,
    }
    assert evaluate(spark, duration_ns, list(cases)) == list(cases.values())
