"""SimHash fingerprints of documents, and search within a Hamming radius by permuted block tables.

Terms are runs of two words (a one-word text has that word). A term's hash votes on each bit with the
term's weight, one more than the binary logarithm of its count, rounded down. All sums are whole
numbers, so equal texts have equal fingerprints, and so have texts with the same words.

Search: the bits are cut into blocks; fingerprints within the radius agree in all but radius of them
at least. Each table moves one choice of blocks to the front and joins on it; the distance of the
whole fingerprints decides. Documents with equal fingerprints are one fingerprint throughout.

Inputs: a null text is an empty one; without words all bits are 0. Rows are fingerprinted one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilscan.llm import kernels as K
from veilscan.llm.store import text_or_empty, write_table

BITS = 128
_ROWS = 4096


def fingerprint(words: np.ndarray) -> bytes:
    terms, counts = np.unique(K.shingle_hashes(words, 2), return_counts=True)
    weights = (np.frexp(counts)[1]).astype(np.float32)  # 1 for 1, 2 for 2 and 3, 3 for 4 to 7
    votes = np.zeros(BITS)
    for k in range(0, len(terms), _ROWS):  # small enough for whole numbers in single precision
        own, weight = terms[k : k + _ROWS], weights[k : k + _ROWS]
        parts = np.stack([own, K.mix(own + K.PLACES[40])], 1)
        bits = np.unpackbits(parts.view(np.uint8), axis=1).astype(np.float32)
        votes += 2.0 * (weight @ bits).astype(np.float64) - float(weight.sum())
    return np.packbits(votes > 0).tobytes()


def fingerprints(texts: pa.Array) -> list[bytes]:
    return [fingerprint(words) for words in K.words_of(texts)]


def likeness(x: bytes, y: bytes) -> float:
    """Share of equal bits."""
    return 1 - (int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_count() / BITS


def add_fingerprints(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """All rows and columns, and the fingerprint as binary."""
    if out_col in docs.columns:
        raise ValueError(f"there is a column {out_col} already")
    position = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in K.slices(whole, position)):
            found = pa.array(fingerprints(batch.column(position)), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, out_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out_col, T.BinaryType())]))


def distance(x: str, y: str) -> F.Column:
    """Hamming distance of two columns of binary fingerprints."""
    words = [
        F.bit_count(F.conv(F.hex(F.substring(x, k, 4)), 16, 10).cast("long").bitwiseXOR(F.conv(F.hex(F.substring(y, k, 4)), 16, 10).cast("long")))
        for k in range(1, BITS // 8 + 1, 4)
    ]
    return sum(words[1:], words[0])


def near_fingerprints(queries: DataFrame, rows: DataFrame, radius: int = 3, blocks: int = 8) -> DataFrame:
    """(query, found, distance) of distinct fingerprints within the radius; equal ones too. Both tables: a column fingerprint.

    Every table is an equality join on blocks - radius of the blocks, so no pair is missed.
    """
    size = BITS // 8 // blocks
    q = queries.select(F.col("fingerprint").alias("query")).filter("query is not null").distinct()
    r = rows.select(F.col("fingerprint").alias("found")).filter("found is not null").distinct()
    tables = list(combinations(range(blocks), blocks - radius))

    def keyed(df: DataFrame, name: str) -> DataFrame:
        keys = [
            F.concat(F.lit(k).cast("string").cast("binary"), *[F.substring(name, 1 + b * size, size) for b in chosen])
            for k, chosen in enumerate(tables)
        ]
        return df.select(name, F.explode(F.array(*keys)).alias("key"))

    pairs = keyed(q, "query").join(keyed(r, "found"), "key").withColumn("distance", distance("query", "found"))
    return pairs.filter(F.col("distance") <= radius).select("query", "found", "distance").distinct()


def _edited(text: str, following: str) -> str:
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


_PAIRED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, "
    "next_fingerprint binary, turn long, end string, text string"
)
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()),
     ("edited_fingerprint", pa.binary()), ("next_fingerprint", pa.binary()), ("turn", pa.int64()), ("end", pa.string()), ("text", pa.string())]
)


def _rows(docs: list[tuple[int | None, str, bytes]], after: list[tuple[int | None, str, bytes]]) -> pa.RecordBatch:
    """Documents (id, text, fingerprint), each with the one after it."""
    edited = [_edited(x[1], y[1]) for x, y in zip(docs, after, strict=True)]
    columns = [
        [x[0] for x in docs], [len(x[1]) for x in docs], [hashlib.sha256(x.encode()).hexdigest() for x in edited], [x[2] for x in docs],
        fingerprints(pa.array(edited, pa.string())), [x[2] for x in after],
    ]
    arrays = [pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=False)]
    return pa.RecordBatch.from_arrays([*arrays, *[pa.nulls(len(docs), f.type) for f in list(_ARROW)[6:]]], schema=_ARROW)


def _end(doc: tuple, turn: int, end: str) -> pa.RecordBatch:
    doc_id, text, mark = doc
    values = [doc_id, None, None, mark, None, None, turn, end, text]
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(values, _ARROW, strict=True)], schema=_ARROW)


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition with their next ones; its first and last document as ends."""
    held, turn = None, TaskContext.get().partitionId()
    for batch in (part for whole in batches for part in K.slices(whole, "text", 2 * K.BLOCK)):
        texts = batch["text"]
        docs = list(zip(batch["doc_id"].to_pylist(), texts.to_pylist(), fingerprints(texts), strict=True))
        if held is None:
            yield _end(docs[0], turn, "first")
        else:
            docs.insert(0, held)
        if len(docs) > 1:
            yield _rows(docs[:-1], docs[1:])
        held = docs[-1]
    if held is not None:
        yield _end(held, turn, "last")


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in batch.to_pylist():
            yield _rows([(x["doc_id"], x["text"], x["fingerprint"])], [(None, x["next_text"], x["next_mark"])])


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of the text with its last third put in from the next document, and of that one.

    The next document has the next smaller doc_id (ties: by hash of the text, then text; null ids come
    last; after the last comes the first, which for a single document is itself). Documents are range-sorted, so that most have their next one
    in the same partition; the ends of the partitions, two rows each, are paired by a window.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.withColumn("turn", F.xxhash64("text"))
    order = [F.desc_nulls_last("doc_id"), F.col("turn"), F.col("text")]
    ordered = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order).select("doc_id", "text")
    done = write_table(ordered.mapInArrow(_along, _PAIRED), "paired")
    ends = done.filter("end is not null")
    along = Window.orderBy("turn", "end")  # partitions go along the order, and "first" before "last"
    text, mark = F.lead("text").over(along), F.lead("fingerprint").over(along)
    least = F.row_number().over(along) == 1
    ends = ends.withColumn("least", least).withColumn("next_text", text).withColumn("next_mark", mark)
    ends = write_table(ends, "ends")
    top = ends.filter("least").select(F.col("text").alias("top_text"), F.col("fingerprint").alias("top_mark"))
    lasts = ends.filter("end = 'last'").join(F.broadcast(top)).select(
        "doc_id", "text", "fingerprint", F.coalesce("next_text", "top_text").alias("next_text"), F.coalesce("next_mark", "top_mark").alias("next_mark")
    )
    out = done.filter("end is null").union(lasts.mapInArrow(_across, _PAIRED))
    return out.drop("turn", "end", "text")
