"""Small column helpers that Spark has no single function for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_EDGE_SPACE = r"\A\p{IsWhite_Space}+|\p{IsWhite_Space}++\z"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it any number of times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns in a way that no later filter or projection evaluates again.

    Catalyst substitutes the expression of a plain projected column into filters above it. The
    output of a generator is opaque to that rewrite, stays in the same stage, and shuffles nothing.
    """
    row = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _UPPER.lower())


def trim_space(text: Column) -> Column:
    """Trim every Unicode white-space character, not only U+0020."""
    return F.regexp_replace(text, _EDGE_SPACE, "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(r"\P{IsWhite_Space}")


def fixed(number: Column, places: int) -> Column:
    """A 32-bit float as text with fixed decimals; exact ties go to the even digit."""
    exact = number.cast("double").cast("decimal(38,18)")
    return F.bround(exact, places).cast(f"decimal(38,{places})").cast("string")


def byte_slice(data: Column, start: Column, length: Column) -> Column:
    """``length`` bytes of a binary column from the 0-based ``start``."""
    return F.substring(data, start + F.lit(1), length)


def utf8_slice(data: Column, start: Column, end: Column) -> Column:
    """Text of the byte range, or the empty string if it does not fall on code points."""
    return let(
        byte_slice(data, start, end - start),
        lambda piece: F.when(
            (F.octet_length(piece) == end - start) & F.is_valid_utf8(piece.cast("string")),
            piece.cast("string"),
        ).otherwise(F.lit("")),
    )


def running_sum(values: Column, block: int = 64) -> Column:
    """Running sum of an array of ints: the sum up to and with each element.

    A fold that appends copies its array on every step, so sums run within blocks, and one short
    fold over the blocks gives where each begins.
    """

    def sums(start: Column, part: Column) -> Column:
        return F.aggregate(
            part,
            F.array(start),
            lambda acc, value: F.array_append(acc, F.element_at(acc, -1) + value),
        )

    def of_blocks(blocks: Column) -> Column:
        totals = F.transform(
            blocks, lambda part: F.aggregate(part, F.lit(0), lambda acc, value: acc + value)
        )
        return let(
            sums(F.lit(0), totals),
            lambda starts: F.flatten(
                F.transform(
                    blocks, lambda part, k: F.slice(sums(F.get(starts, k), part), 2, block)
                )
            ),
        )

    last = F.floor((F.size(values) - F.lit(1)) / F.lit(block)).cast("int")
    blocks = F.transform(
        F.sequence(F.lit(0), last),
        lambda k: F.slice(values, k * F.lit(block) + F.lit(1), F.lit(block)),
    )
    return F.when(F.size(values) > 0, let(blocks, of_blocks)).otherwise(
        F.array().cast("array<int>")
    )
