"""Cutting text into disjoint chunks of bounded byte length that cover it.

A chunk ends after the last newline of its window; if the window has no newline at all, after the
last space; else at the window's end, moved back to a code-point boundary. A newline or a space at
the very start of a window is no place to cut.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilscan.functions.columns import byte_slice, let


def _in_code_point(data: Column, pos: Column) -> Column:
    """Whether the byte at ``pos`` continues a code point, so that no cut may precede it."""
    return F.hex(byte_slice(data, pos, F.lit(1))).rlike("^[89AB]")


def _hard_cut(data: Column, pos: Column, size: int) -> Column:
    end = pos + F.lit(size)
    cut = end - F.lit(3)
    for back in (2, 1, 0):
        cut = F.when(~_in_code_point(data, end - F.lit(back)), end - F.lit(back)).otherwise(cut)
    return cut


def _next_cut(data: Column, pos: Column, size: int) -> Column:
    """Where the chunk that starts at ``pos`` ends, given that more than ``size`` bytes are left."""

    def after_last(window: Column, delimiter: str) -> Column:
        return F.lit(size) - F.octet_length(F.substring_index(window, delimiter, -1))

    def cut(window: Column) -> Column:
        newline = after_last(window, "\n")
        space = after_last(window, " ")
        return (
            F.when(newline > 1, pos + newline)
            .when((newline == 0) & (space > 1), pos + space)
            .otherwise(_hard_cut(data, pos, size))
        )

    return let(byte_slice(data, pos, F.lit(size)).cast("string"), cut)


def chunk_starts(text: Column, size: int) -> Column:
    """Byte offset of every chunk, in order."""

    def starts_of(data: Column) -> Column:
        length = F.octet_length(data)
        # Two short chunks in a row use up the last newline and the last space of a window, so
        # any three together are longer than a window less the bytes of a split code point.
        steps = F.lit(3) * F.floor(length / F.lit(size - 3)).cast("int") + F.lit(3)
        # A fold copies its array on every step. Gathering the starts in blocks of about the
        # square root of their number keeps that small even for the largest documents.
        block_size = F.ceil(F.lit(2) * F.sqrt(steps)).cast("int")

        def last(starts: Column) -> Column:
            return F.element_at(starts, -1)

        def add_start(starts: Column, _: Column) -> Column:
            return F.when(length - last(starts) <= size, starts).otherwise(
                F.array_append(starts, _next_cut(data, last(starts), size))
            )

        def add_block(blocks: Column, _: Column) -> Column:
            block = F.aggregate(
                F.sequence(F.lit(1), block_size),
                F.array(last(last(blocks))),
                add_start,
                lambda starts: F.slice(starts, F.lit(2), F.size(starts)),
            )
            return F.when(length - last(last(blocks)) <= size, blocks).otherwise(
                F.array_append(blocks, block)
            )

        return F.aggregate(
            F.sequence(F.lit(1), F.ceil(steps / block_size).cast("int")),
            F.array(F.array(F.lit(0))),
            add_block,
            F.flatten,
        )

    return F.when(
        F.octet_length(text) > size, let(text.cast("binary"), starts_of)
    ).otherwise(F.array(F.lit(0)))


def chunk_text(text: Column, size: int) -> Column:
    """``array<struct<chunk_idx, offset, text>>``; offsets are bytes from the document's start."""

    def sliced(data: Column, starts: Column) -> Column:
        def chunk(start: Column, idx: Column) -> Column:
            end = F.coalesce(F.get(starts, idx + F.lit(1)), F.octet_length(data))
            return F.struct(
                idx.alias("chunk_idx"),
                start.alias("offset"),
                byte_slice(data, start, end - start).cast("string").alias("text"),
            )

        return F.transform(starts, chunk)

    whole = F.array(
        F.struct(F.lit(0).alias("chunk_idx"), F.lit(0).alias("offset"), text.alias("text"))
    )
    return F.when(
        F.octet_length(text) > size,
        let(text.cast("binary"), lambda data: let(chunk_starts(text, size), lambda s: sliced(data, s))),
    ).otherwise(whole)
