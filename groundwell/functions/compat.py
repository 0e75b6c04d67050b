"""Functions of other SQL dialects, as Spark columns.

All are compositions of built-in functions, so they stay in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Strftime letters and Spark's pattern letters.
STRFTIME = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "j": "DDD"}


def total(column: Column) -> Column:
    """A sum that is 0.0 on no rows."""
    return F.coalesce(F.sum(column.cast("double")), F.lit(0.0))


def group_concat(column: Column, separator: str = ",") -> Column:
    """All non-null values, sorted and joined; map-side combined as arrays."""
    return F.array_join(F.array_sort(F.collect_list(column.cast("string"))), separator)


def strftime(pattern: str, column: Column) -> Column:
    """``date_format`` by a strftime pattern; other letters are refused."""
    out, k = [], 0
    while k < len(pattern):
        if pattern[k] == "%":
            letter = pattern[k + 1 : k + 2]
            if letter not in STRFTIME:
                raise ValueError(f"unsupported strftime letter %{letter}")
            out.append(STRFTIME[letter])
            k += 2
        else:
            out.append("'" + pattern[k].replace("'", "''") + "'" if pattern[k].isalpha() or pattern[k] == "'" else pattern[k])
            k += 1
    return F.date_format(column, "".join(out))


def julianday(column: Column) -> Column:
    """Days since noon of 24 November 4714 BC (Gregorian), with fractions."""
    return F.unix_micros(column.cast("timestamp")) / F.lit(86_400_000_000.0) + F.lit(2_440_587.5)


def int_div(left: Column, right: Column) -> Column:
    """Integer division that truncates and is null on a zero divisor."""
    return F.call_function("div", left, F.nullif(right, F.lit(0)))


def money(cents: Column, symbol: str = "€") -> Column:
    """Whole cents as text, the sign before the symbol; null stays null."""
    whole = F.abs(cents)
    digits = F.format_number((whole / 100).cast("decimal(20,2)"), 2)
    return F.concat(F.when(cents < 0, F.lit("-")).otherwise(F.lit("")), F.lit(symbol), digits)


def to_cents(amount: Column) -> Column:
    """An amount in units as whole cents, halves away from zero."""
    return F.round(amount * 100).cast("long")


def wilson(passes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Low and high end of the Wilson score interval; null when n is 0."""
    p = passes / F.nullif(n, F.lit(0))
    centre = p + z * z / 2 / n
    half = F.lit(z) * F.sqrt(p * (1 - p) / n + z * z / 4 / (n * n))
    scale = 1 + z * z / n
    return (centre - half) / scale, (centre + half) / scale


def priced(tokens: Column, micro_per_1k: int) -> Column:
    """Cost in whole micro-units, rounded up."""
    return F.call_function("div", tokens * micro_per_1k + 999, F.lit(1000)).cast("long")
