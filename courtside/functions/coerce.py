"""Text-to-value coercion as native column expressions.

Spark casts are laxer than the rules needed here (they trim blanks and accept type
suffixes), so each cast is guarded by an anchored pattern. Bad text becomes 0, 0.0 or ''.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Unicode White_Space: tab..carriage return, blank, NEL and the Z categories.
SPACE = r"[\t-\r \u0085\p{Z}]"
SPACE_CHARS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + (
    "\u2028\u2029\u202f\u205f\u3000"
)
INT_TEXT = r"\A[+-]?[0-9]+\z"
FLOAT_TEXT = r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"

INT64_MAX = 9223372036854775807
INT64_MIN = -9223372036854775808


def strict_int(text: Column) -> Column:
    """Base-10 integer with optional sign, else 0; out-of-range text clamps to int64."""
    clamped = F.when(text.startswith("-"), F.lit(INT64_MIN)).otherwise(F.lit(INT64_MAX))
    return F.when(text.rlike(INT_TEXT), F.coalesce(text.try_cast("bigint"), clamped)).otherwise(
        F.lit(0).cast("bigint")
    )


def strict_float(text: Column) -> Column:
    """Decimal or exponent notation, else 0.0; overflow keeps the signed infinity."""
    return F.when(text.rlike(FLOAT_TEXT), text.try_cast("double")).otherwise(F.lit(0.0))


def trim_space(text: Column) -> Column:
    """Strip Unicode white space (including NBSP) on both ends."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def fields(text: Column) -> Column:
    """Split around runs of white space; no empty tokens."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda token: token != "")


def first_nonzero(*candidates: Column) -> Column:
    *heads, last = candidates
    return F.coalesce(*[F.nullif(head, F.lit(0)) for head in heads], last)


def first_nonempty(*candidates: Column) -> Column:
    *heads, last = candidates
    return F.coalesce(*[F.nullif(head, F.lit("")) for head in heads], last)


def zip_last_wins(keys: Column, values: Column, repeated: Column | None = None) -> Column:
    """Pair by position into a map; of repeated keys the last paired value stays.

    Keys beyond the last value are left out; there must not be more values than keys.
    Needs no session-wide map setting: repeated keys are resolved before the map is built.
    ``repeated`` may carry the answer to "does any key repeat" when it is known.
    """
    if repeated is None:
        repeated = F.size(F.array_distinct(keys)) < F.size(keys)
    paired = F.slice(keys, F.lit(1), F.size(values))
    backwards = F.reverse(paired)
    distinct = F.array_distinct(backwards)
    newest = F.transform(
        distinct, lambda key: F.get(F.reverse(values), F.array_position(backwards, key) - 1)
    )
    return F.when(repeated, F.map_from_arrays(distinct, newest)).otherwise(
        F.map_from_arrays(paired, values)
    )


def lookup(mapping: Column, key: str) -> Column:
    """Map value, or '' where the key is missing."""
    return F.coalesce(F.try_element_at(mapping, F.lit(key)), F.lit(""))
