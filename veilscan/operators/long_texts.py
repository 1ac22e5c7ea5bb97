"""Chunking of very long texts by many tasks.

The chunks are those of ``chunk_text``. Where a chunk begins depends on the one before it, but only so far:
a text is cut into blocks of equal length, and for every place in a block at which a chunk may begin
that reaches into it, its task finds by pointers from each byte to the next cut where the first
chunk behind the block begins, and how many begin inside. One pass over these tables, a few bytes for each
place, tells where every block is entered; then each task cuts its own block.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilscan.functions.columns import byte_slice
from veilscan.operators.chunking import chunk_text
from veilscan.sources.shared import written

#: Bytes of a block. Texts of no more are cut in their row.
BLOCK = 1 << 20


def next_cuts(data: np.ndarray, n: int, size: int, left: int) -> np.ndarray:
    """For each of the first n bytes, where a chunk that begins there ends; left: bytes of the text from here on.

    ``data`` reaches ``size`` bytes beyond the last of them, or to the end of the text.
    """
    at = np.arange(n)
    last = np.minimum(at + size, len(data)) - 1  # of the window
    places = np.arange(len(data))

    def after(byte: int) -> np.ndarray:
        """Bytes of each window up to and with its last such byte, 0 without one."""
        seen = np.maximum.accumulate(np.where(data == byte, places, -1))[last]
        return np.where(seen >= at, seen - at + 1, 0)

    newline, space = after(10), after(32)
    hard = at + size
    inner = np.append((data & 0xC0) == 0x80, np.zeros(size + 4, bool))  # bytes that go on with a code point
    cut = hard - 3
    for back in (2, 1, 0):
        cut = np.where(inner[np.maximum(hard - back, 0)], cut, hard - back)
    out = np.where(newline > 1, at + newline, np.where((newline == 0) & (space > 1), at + space, cut))
    return np.where(left - at <= size, left, out)


def _ways(batches: Iterator[pa.RecordBatch], size: int, block: int) -> Iterator[pa.RecordBatch]:
    """Of each block: where chunks lead that begin at its first bytes, and how many of them begin in it."""
    for batch in batches:
        for row, number, total, body in zip(*(batch[c].to_pylist() for c in ("_row", "_block", "_total", "_data")), strict=True):
            data = np.frombuffer(body, np.uint8)
            left = total - number * block
            n = min(block, left)
            cuts = next_cuts(data, n, size, left)
            at = np.arange(min(size, n) if number else 1)  # an earlier chunk ends at most size bytes into the block
            steps = np.zeros(len(at), np.int64)
            while (inside := at < n).any():
                at[inside] = cuts[at[inside]]
                steps[inside] += 1
            yield pa.record_batch(
                {
                    "_row": pa.array([row], pa.int64()), "_block": pa.array([number], pa.int32()),
                    "_to": pa.array([(at - n).astype("<i4").tobytes()], pa.binary()), "_steps": pa.array([steps.astype("<i4").tobytes()], pa.binary()),
                }
            )


def _entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where the first chunk of each block begins, and its number; rows come sorted by row and block."""
    row, at, idx = None, 0, 0
    for batch in batches:
        begins, numbers = [], []
        for own, to, steps in zip(*(batch[c].to_pylist() for c in ("_row", "_to", "_steps")), strict=True):
            if own != row:
                row, at, idx = own, 0, 0
            begins.append(at), numbers.append(idx)
            to, steps = np.frombuffer(to, "<i4"), np.frombuffer(steps, "<i4")
            # a chunk that reaches over a whole last block has no place in it
            at, idx = (int(to[at]), idx + int(steps[at])) if at < len(to) else (at, idx)
        yield pa.record_batch(
            {
                "_row": batch["_row"], "_block": batch["_block"],
                "_at": pa.array(begins, pa.int32()), "_idx": pa.array(numbers, pa.int32()),
            }
        )


def _cut(batches: Iterator[pa.RecordBatch], size: int, block: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k, (number, total, body, at, idx) in enumerate(zip(*(batch[c].to_pylist() for c in ("_block", "_total", "_data", "_at", "_idx")), strict=True)):
            left = total - number * block
            n = min(block, left)
            if at >= n:
                continue
            cuts = next_cuts(np.frombuffer(body, np.uint8), n, size, left)
            starts, ends = [], []
            while at < n:
                starts.append(at)
                at = int(cuts[at])
                ends.append(at)
            own = [batch.column(c).take(pa.array(np.full(len(starts), k))) for c in range(len(schema) - 3)]
            texts = [body[a:b].decode("utf-8", "replace") for a, b in zip(starts, ends, strict=True)]
            columns = [
                pa.array(range(idx, idx + len(starts)), pa.int32()),
                pa.array(np.array(starts) + number * block, pa.int32()), pa.array(texts, pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*own, *columns], schema=schema)


def chunk_long_texts(df: DataFrame, keys: Sequence[str], text_col: str, size: int, block: int = BLOCK) -> DataFrame:
    """Rows ``(*keys, chunk_idx, offset, text)`` of the chunks of a text column; NULL texts have none.

    Rows that repeat their keys are cut one by one. ``block`` has to be at least ``size``.
    """
    if block < size or size < 4:
        raise ValueError("A block is at least a chunk, and a chunk at least 4 bytes")
    taken = {"chunk_idx", "offset", "text", "_row", "_block", "_total", "_data", "_at", "_idx"} & set(keys)
    if taken:
        raise ValueError(f"Rename the columns {sorted(taken)}; chunks use these names")
    text = F.col(text_col)
    short = df.filter(F.octet_length(text) <= block).select(*keys, F.inline(chunk_text(text, size)))
    long = df.filter(F.octet_length(text) > block).select(
        *keys, F.monotonically_increasing_id().alias("_row"), F.octet_length(text).alias("_total"), text.cast("binary").alias("_data")
    )
    numbers = F.explode(F.sequence(F.lit(0), ((F.col("_total") - 1) / F.lit(block)).cast("int")))
    blocks = long.select("*", numbers.alias("_block"))
    start = F.col("_block") * F.lit(block)
    blocks = blocks.withColumn("_data", byte_slice(F.col("_data"), start, F.lit(block + size + 4)))
    blocks = written(blocks.repartition("_row", "_block"))
    ways = blocks.select("_row", "_block", "_total", "_data").mapInArrow(
        lambda it: _ways(it, size, block), "_row long, _block int, _to binary, _steps binary"
    )
    entered = ways.repartition("_row").sortWithinPartitions("_row", "_block").mapInArrow(
        _entered, "_row long, _block int, _at int, _idx int"
    )
    entered = written(entered)  # of known size, so that it is what a small join sends around, and not the blocks
    found = blocks.join(entered, ["_row", "_block"]).select(*keys, "_block", "_total", "_data", "_at", "_idx")
    kinds = T.StructType([*[df.schema[name] for name in keys], *_CHUNK])
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(kinds)
    return short.unionByName(found.mapInArrow(lambda it: _cut(it, size, block, schema), kinds))


_CHUNK = [T.StructField("chunk_idx", T.IntegerType()), T.StructField("offset", T.IntegerType()), T.StructField("text", T.StringType())]
