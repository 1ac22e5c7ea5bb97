"""Parsing of textual request options."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilscan.functions.columns import trim_space

# Spellings of true. Every other text is false.
TRUE_WORDS = ["true", "1", "yes", "on"]


def parse_bool(text: Column) -> Column:
    return F.lower(trim_space(text)).isin(TRUE_WORDS)


def parse_int(text: Column) -> Column:
    """Non-negative whole number, NULL if the text is not one."""
    digits = trim_space(text)
    return F.when(digits.rlike(r"\A\+?[0-9]+\z"), digits.try_cast("bigint"))


def parse_float(text: Column) -> Column:
    """32-bit float, NULL if the text is not a number."""
    return trim_space(text).try_cast("float")


def parse_list(text: Column) -> Column:
    """Comma-separated list: items trimmed, empty items dropped."""
    return F.filter(F.transform(F.split(text, ","), trim_space), lambda item: item != "")
