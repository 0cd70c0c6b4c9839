"""Tolerant number and text parsing of free-form tag values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: whitespace stripped at both ends, digit alphabets read as 0-9
WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85    　"
ARABIC_INDIC, EXTENDED_INDIC, DEVANAGARI = "٠١٢٣٤٥٦٧٨٩", "۰۱۲۳۴۵۶۷۸۹", "०१२३४५६७८९"
FULL_WIDTH = "０１２３４５６７８９"
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(WHITESPACE))


def non_empty(value: Column) -> Column:
    return F.nullif(strip(value), F.lit(""))


def to_float(value: Column) -> Column:
    """Finite number or null; never an error."""
    text = F.translate(strip(value), ARABIC_INDIC + EXTENDED_INDIC + DEVANAGARI + FULL_WIDTH, "0123456789" * 4)
    number = F.when(text.rlike(NUMBER), text.try_cast("double"))
    return F.when(F.abs(number) < float("inf"), number)


def positive_float(value: Column) -> Column:
    n = to_float(value)
    return F.when(n > 0, n)


def positive_int(value: Column) -> Column:
    """Truncates '3.7' to 3; zero and below are absent."""
    n = to_float(value).try_cast("bigint")
    return F.when(n > 0, n)


def lower_tag(value: Column) -> Column:
    return F.lower(strip(F.coalesce(value, F.lit(""))))
