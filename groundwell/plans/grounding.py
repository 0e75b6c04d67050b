"""Figures in sentences: numeric tokens, their normal form, and whether cells back them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dates; and signed numbers with currency, separators, decimals and percent.
ISO_DATE = r"[0-9]{4}-[0-9]{2}(?:-[0-9]{2})?"
NUMERIC_TOKEN = ISO_DATE + r"|-?[$€£¥]?[0-9][0-9,]*(?:\.[0-9]+)?%?"
CURRENCY = "$€£¥,"


def numeric_tokens(text: Column) -> Column:
    """Every date and number of a text, in order, as written."""
    return F.regexp_extract_all(text, F.lit(NUMERIC_TOKEN), F.lit(0))


def normal_form(token: Column) -> Column:
    """A token reduced to its value: a date as it is, a number without currency,
    separators and idle zeros; a percentage stays one."""
    plain = F.translate(token, CURRENCY + "%", "")
    plain = F.regexp_replace(plain, r"^(-?)0+(?=[0-9])", "$1")
    plain = F.regexp_replace(plain, r"(\.[0-9]*?)0+$", "$1")
    plain = F.regexp_replace(plain, r"\.$", "")
    number = F.concat(plain, F.when(token.endswith("%"), F.lit("%")).otherwise(F.lit("")))
    return F.when(token.rlike(f"^(?:{ISO_DATE})$"), token).otherwise(number)


def ungrounded(sentence: Column, cells: Column) -> Column:
    """The numeric tokens of a sentence whose value is in no cell (an array of text), as written."""
    allowed = F.transform(F.flatten(F.transform(cells, numeric_tokens)), normal_form)
    return F.filter(numeric_tokens(sentence), lambda t: ~F.array_contains(allowed, normal_form(t)))
