"""Tables written to the folder that all executors share, and fixed-width sums over all partitions."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Counters in one row while partial arrays are summed.
CHUNK = 1 << 14


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, one beside the warehouse's tables."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return root.rstrip("/")


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back, which cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _merge(batches: Iterator[pa.RecordBatch], dtype: str, bits: bool) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, data in zip(batch["chunk"].to_pylist(), batch["data"].to_pylist(), strict=True):
            part = np.frombuffer(data, dtype)
            if chunk not in total:
                total[chunk] = part.copy()
            elif bits:
                total[chunk] |= part
            else:
                total[chunk] += part
    for chunk, part in total.items():
        yield pa.record_batch({"chunk": pa.array([chunk], pa.int32()), "data": pa.array([part.tobytes()], pa.binary())})


def array_rows(array: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The chunks of an array that aren't all zero, as (number, bytes)."""
    for k in range(0, len(array), CHUNK):
        part = array[k : k + CHUNK]
        if part.any():
            yield k // CHUNK, part.tobytes()


def sum_arrays(rows: DataFrame, width: int, dtype: str, bits: bool = False) -> np.ndarray:
    """Sum (or, with bits, join) the arrays whose chunks are rows of (chunk, data).

    The result has a fixed width whatever the input, so that it may go to the driver and be broadcast.
    Each chunk number is one shuffle partition's work, streamed.
    """
    merged = (
        rows.select("chunk", "data")
        .repartition("chunk")
        .mapInArrow(lambda it: _merge(it, dtype, bits), "chunk int, data binary")
    )
    out = np.zeros(width, dtype)
    for row in merged.collect():  # width / CHUNK rows, whatever the input
        part = np.frombuffer(row.data, dtype)
        out[row.chunk * CHUNK : row.chunk * CHUNK + len(part)] = part
    return out


def partition_arrays(
    df: DataFrame, fill: Callable[[pa.RecordBatch, np.ndarray], None], width: int, dtype: str, bits: bool = False
) -> np.ndarray:
    """Let each partition fill an array of fixed width from its batches, and sum the arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = np.zeros(width, dtype)
        for batch in batches:
            fill(batch, array)
        for chunk, data in array_rows(array):
            yield pa.record_batch({"chunk": pa.array([chunk], pa.int32()), "data": pa.array([data], pa.binary())})

    return sum_arrays(df.mapInArrow(run, "chunk int, data binary"), width, dtype, bits)


#: Bits of a Bloom filter: 4 MiB, whatever the input. A full one lets more rows pass, and loses none.
BLOOM_BITS = 1 << 25


def bloom_of(items: DataFrame) -> np.ndarray:
    """A Bloom filter (two bits each) of one column of hashes: bigint, or binary of which the first 8 bytes count."""

    def fill(batch: pa.RecordBatch, array: np.ndarray) -> None:
        column = batch.column(0)
        if pa.types.is_binary(column.type):
            h = np.array([int.from_bytes(x[:8], "little") for x in column.to_pylist()], np.uint64)
        else:
            h = column.to_numpy(zero_copy_only=False).view(np.uint64)
        for bit in (h % BLOOM_BITS, (h >> np.uint64(32)) % BLOOM_BITS):
            np.bitwise_or.at(array, (bit >> np.uint64(3)).astype(np.int64), (1 << (bit & np.uint64(7))).astype(np.uint8))

    return partition_arrays(items, fill, BLOOM_BITS // 8, "uint8", bits=True)


def in_bloom(bloom: np.ndarray, h: np.ndarray) -> np.ndarray:
    h = h.view(np.uint64)
    out = np.ones(len(h), bool)
    for bit in (h % BLOOM_BITS, (h >> np.uint64(32)) % BLOOM_BITS):
        out &= (bloom[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 != 0
    return out


def text_or_empty(name: str = "text") -> F.Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fresh(name: str, taken: list[str]) -> str:
    """A name that no column has, whatever the case of its letters."""
    taken = {x.lower() for x in taken}
    while name.lower() in taken or f"{name}_".lower() in taken:
        name += "_"
    return name
