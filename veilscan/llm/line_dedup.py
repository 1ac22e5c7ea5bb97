"""Fuzzy line deduplication: MinHash bands, exact Jaccard tests, and union-find over lines.

A line is a part of a text between newlines. Its shingles are its runs of SHINGLE characters. Lines
that share a band of MinHash values are candidates, and link if the Jaccard similarity of their whole
shingle sets reaches the threshold. Lines with the same characters are one item throughout. Of each
component of linked lines the first occurrence stays, by (doc_id, text hash, line number); all others
are cut out of their documents, with their newline.

Inputs: a null text stays null and a text without lines to drop stays as it is. Blank lines are
no copies of each other and stay. Lines shorter than SHINGLE only have exact copies. A document is
known by id and text, so rows that repeat both are one document and both keep what it keeps; null ids
come first in the order. All other columns pass through unchanged, whatever their names; dropped_col is
added last and raises if there is a column of its name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilscan.llm import kernels as K
from veilscan.llm.linkage import SKETCH_FIELDS, alike, linked_items, members, sketch_columns
from veilscan.llm.store import bloom_of, fresh, in_bloom, write_table

SHINGLE = 8
BANDS = 10
ROWS = 4
_rng = np.random.default_rng(4)
_A = _rng.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)


def shingles(points: np.ndarray) -> np.ndarray:
    """Hashes of the runs of SHINGLE code points."""
    h, p, step = points.astype(K.U), 0x9E3779B97F4A7C15, 1
    while step < SHINGLE:
        h = h[:-step] * K.U(p) + h[step:]
        p, step = p * p % 2**64, step * 2
    return K.mix(h)


def band_hashes(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Bands (one row per line) of lines whose shingles begin at starts."""
    low = hashes.astype(np.uint32)
    bands = np.empty((len(starts), BANDS), K.U)
    for band in range(BANDS):
        total = np.full(len(starts), K.U(band + 1)) * K.PLACES[60]
        for row in range(ROWS):
            k = band * ROWS + row
            total += np.minimum.reduceat(low * _A[k] + _B[k], starts).astype(K.U) * K.PLACES[row]
        bands[:, band] = K.mix(total)
    return bands


def line_key(line: str) -> int:
    """64 bits of a line, as a signed number."""
    return int.from_bytes(hashlib.blake2b(line.encode(), digest_size=8).digest(), "little", signed=True)


def _lines(text: str) -> list[tuple[int, str]]:
    """Numbers and lines of a text, without blank ones."""
    return [(k, line) for k, line in enumerate(text.split("\n")) if line and not line.isspace()]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in K.slices(whole, "text", K.BLOCK)):
        lines = {line for text in batch["text"].to_pylist() for _, line in _lines(text or "") if len(line) >= SHINGLE}
        if not lines:
            continue
        lines = sorted(lines)
        sizes = np.array([len(line) - SHINGLE + 1 for line in lines])
        hashes = shingles(K.code_points("".join(lines)))
        ends = np.cumsum(sizes + SHINGLE - 1)
        keep = np.ones(len(hashes), bool)  # not those that reach into the next line
        for j in range(1, SHINGLE):
            keep[ends[:-1] - j] = False
        hashes, starts = hashes[keep], np.cumsum(sizes) - sizes
        bands = band_hashes(hashes, starts)
        keys = np.array([line_key(line) for line in lines], np.int64)
        yield pa.record_batch(
            {
                "sig": pa.array(bands.view(np.int64).ravel()),
                "item": pa.array(np.repeat(keys, BANDS)),
            }
        )


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in K.slices(whole, "text")):
        rows, numbers, keys = [], [], []
        for k, text in enumerate(batch["text"].to_pylist()):
            for number, line in _lines(text or ""):
                rows.append(k), numbers.append(number), keys.append(line_key(line))
        yield pa.record_batch(
            {
                "id": batch["id"].take(pa.array(rows, pa.int64())),
                "text_key": batch["text_key"].take(pa.array(rows, pa.int64())),
                "line": pa.array(numbers, pa.int32()),
                "item": pa.array(keys, pa.int64()),
            }
        )


def _linking(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch["x"].to_pylist(), batch["y"].to_pylist()
            sets = {line: np.unique(shingles(K.code_points(line))) for line in {*left, *right}}
            keep = [alike(sets[x], sets[y], percent) for x, y in zip(left, right, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def line_components(texts: DataFrame, percent: int = 80) -> DataFrame:
    """(item, root) of the lines of a column text that link with another line; items are line_key()s."""
    texts = texts.select("text")
    shared = members(texts.mapInArrow(_sign, "sig long, item long"))
    bloom = texts.sparkSession.sparkContext.broadcast(bloom_of(shared.select("item").distinct()))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in K.slices(whole, "text")):
            lines = {line for text in batch["text"].to_pylist() for _, line in _lines(text or "") if len(line) >= SHINGLE}
            lines = sorted(lines)
            keys = np.array([line_key(line) for line in lines], np.int64)
            keep = pa.array(in_bloom(bloom.value, keys)) if lines else pa.array([], pa.bool_())
            keys, lines = pa.array(keys).filter(keep), pa.array(lines, pa.string()).filter(keep)
            sets = [np.unique(shingles(K.code_points(line))) for line in lines.to_pylist()]
            yield pa.record_batch({"item": keys, "body": lines} | sketch_columns(sets))

    bodies = texts.mapInArrow(gather, f"item long, body string, {SKETCH_FIELDS}")
    bodies = write_table(bodies.dropDuplicates(["item"]), "bodies")

    lines = bodies.select("item", "body")

    def verify(pairs: DataFrame) -> DataFrame:
        both = pairs.join(lines.toDF("a", "x"), "a").join(lines.toDF("b", "y"), "b").select("a", "b", "x", "y")
        return both.mapInArrow(_linking(percent), "a long, b long")

    return linked_items(shared, percent, bodies, verify)


def _cut(position: int, dropped: int):
    """Drop the lines numbered in column dropped from the texts at position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in K.slices(whole, position)):
            out = []
            for text, gone in zip(batch.column(position).to_pylist(), batch.column(dropped).to_pylist(), strict=True):
                if gone:
                    gone = set(gone)
                    text = "\n".join(line for k, line in enumerate(text.split("\n")) if k not in gone)
                out.append(text)
            columns = batch.columns
            columns[position] = pa.array(out, pa.string())
            columns[dropped] = pc.fill_null(pc.list_value_length(batch.column(dropped)), 0)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return run


#: A key with more than this share of the rows is hot; there are fewer hot keys than its inverse.
HOT = 4096


def _spread_join(rows: DataFrame, facts: DataFrame, key: str, weight: str) -> DataFrame:
    """Join facts, one row a key, to rows; weight: how many rows have the key. Facts of hot keys go to all tasks, HOT at most."""
    hot = F.col(weight) * HOT > rows.count()
    cold = rows.join(F.broadcast(facts.filter(hot).select(key)), key, "left_anti").join(facts.filter(~hot), key)
    return cold.unionByName(rows.join(F.broadcast(facts.filter(hot)), key))


def dedup_lines(
    docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", dropped_col: str | None = None
) -> DataFrame:
    """The documents without repeated lines; dropped_col: name of an added column, how many lines went."""
    names = docs.columns
    extra = fresh("_gone", names) if dropped_col is None else dropped_col
    if extra in names:
        raise ValueError(f"there is a column {extra} already")
    doc = F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_key")
    text = F.col(text_col).cast("string").alias("text")
    found = docs.select(*doc, text).mapInArrow(_occurrences, "id long, text_key long, line int, item long")
    found = write_table(found, "lines")
    roots = line_components(docs.select(text), percent)
    place = F.struct("id", "text_key", "line")
    n = F.count(F.lit(1)).alias("n")
    items = write_table(found.groupBy("item").agg(F.min(place).alias("first"), n), "items")
    named = items.join(roots, "item", "left").withColumn("root", F.coalesce("root", "item"))
    named = write_table(named, "named")
    groups = named.groupBy("root").agg(F.min("first").alias("kept"), F.sum("n").alias("all"), n.alias("items")).filter(F.col("all") > 1)
    changed = _spread_join(named.select("item", "root", "n"), write_table(groups, "groups"), "root", "items")
    changed = write_table(changed.select("item", "kept", "n"), "changed")
    gone = _spread_join(found, changed, "item", "n").filter(~place.eqNullSafe(F.col("kept"))).select("id", "text_key", "line")
    gone = gone.distinct().groupBy("id", "text_key").agg(F.collect_list("line").alias("gone"))
    own = [fresh(x, names) for x in ("_id", "_text_key")]
    rows = docs.withColumn(own[0], doc[0]).withColumn(own[1], doc[1])
    gone = gone.toDF(*[x + "_" for x in own], extra)
    match = F.col(own[0]).eqNullSafe(F.col(own[0] + "_")) & (F.col(own[1]) == F.col(own[1] + "_"))
    rows = rows.join(gone, match, "left").select(*[f"`{x}`" for x in names], extra)
    rows = rows.withColumn(text_col, F.col(f"`{text_col}`").cast("string"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField(extra, T.IntegerType())])
    out = rows.mapInArrow(_cut(names.index(text_col), len(names)), schema)
    return out if dropped_col else out.drop(extra)
