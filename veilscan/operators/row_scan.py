"""Scans of whole texts in Arrow batches, for scorers whose tokens are many.

A scorer that offers ``finder`` has its texts cut, scored, merged, sliced and deduplicated in numpy, many
documents at a time, and only entities come back. Every step follows the rules of its column expression:
``chunk_text``, ``merge_tokens``, ``utf8_slice`` and ``distinct_entities``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan import schemas
from veilscan.operators.pattern_scorer import OUTSIDE

#: Bytes of text whose entities are held at once, beside those of one document.
PART_BYTES = 1 << 20

#: Chunk, label, start, end and score of spans; starts and ends count from their chunk.
Spans = list[np.ndarray]
#: From bytes and the borders of their chunks to spans, a part of the chunks at a time and in order.
Finder = Callable[[np.ndarray, np.ndarray], Iterator[Spans]]


class Merger:
    """Spans of scored tokens, by the rules of ``merge_tokens``."""

    def __init__(self, vocabulary: Sequence[str], labels: Sequence[str], threshold: float) -> None:
        lower = lambda name: "".join(c.lower() if c.isascii() else c for c in name)
        wanted = {lower(name) for name in labels}
        # Equal names are one label. The last place is that of an index outside the vocabulary.
        self.same = np.array([vocabulary.index(name) for name in vocabulary] + [-1])
        self.outside = np.array([name == OUTSIDE for name in vocabulary] + [False])
        asked = [name == OUTSIDE or not wanted or lower(name) in wanted for name in vocabulary]
        self.seen = np.array([*asked, False])
        self.threshold = np.float32(threshold)

    def __call__(self, tokens: list[np.ndarray], chunk: np.ndarray) -> Spans:
        """Tokens of a chunk stand together and in order."""
        start, end, idx, score = tokens
        idx = np.where((idx >= 0) & (idx < len(self.same) - 1), idx, len(self.same) - 1)
        seen = (end > start) & self.seen[idx]
        start, end, idx, score, chunk = (x[seen] for x in (start, end, idx, score, chunk))
        if not len(start):
            return [x[:0] for x in (chunk, idx, start, end, score)]
        hit = ~self.outside[idx] & ~(score < self.threshold)
        label = self.same[idx]
        extends = np.zeros(len(start), bool)
        extends[1:] = (
            hit[1:] & hit[:-1] & (label[1:] == label[:-1]) & (end[:-1] == start[1:]) & (chunk[1:] == chunk[:-1])
        )
        first = np.flatnonzero(~extends)
        last = np.append(first[1:], len(start)) - 1
        most = np.maximum.reduceat(score, first)
        kept = hit[first]
        first, last = first[kept], last[kept]
        return [chunk[first], label[first], start[first], end[last], most[kept]]


def chunk_cuts(data: bytes, size: int) -> list[int]:
    """Byte offset of every chunk of a text, as ``chunk_starts`` has them."""
    starts, pos = [0], 0
    while len(data) - pos > size:
        end = pos + size
        newline = data.rfind(b"\n", pos, end) + 1 - pos
        space = data.rfind(b" ", pos, end) + 1 - pos if newline < 1 else 0
        if newline > 1:
            pos += newline
        elif newline < 1 and space > 1:
            pos += space
        else:
            pos = next((end - back for back in (0, 1, 2) if data[end - back] & 0xC0 != 0x80), end - 3)
        starts.append(pos)
    return starts


def first_of_equal(*keys: np.ndarray) -> np.ndarray:
    """Whether each row is the first that has its keys, which are counts from 0."""
    n = len(keys[0])
    first = np.ones(n, bool)
    if n < 2:
        return first
    # One number of all keys, if 63 bits can hold it.
    room, packed = 1, np.zeros(n, np.int64)
    for key in keys:
        width = int(key.max()) + 1
        room *= width
        if int(key.min()) < 0 or room >= 1 << 63:
            order = np.lexsort(keys)
            break
        packed = packed * width + key
    else:
        order, keys = np.argsort(packed, kind="stable"), (packed,)
    repeats = np.ones(n - 1, bool)
    for key in keys:
        repeats &= key[order[1:]] == key[order[:-1]]
    first[order[1:][repeats]] = False
    return first


def scan_texts(text: Column, make_finder: Callable[[], Finder], vocabulary: Sequence[str], size: int) -> Column:
    """``struct<entities, chunks>``: the distinct entities of a text and the number of its chunks; NULL has none."""
    names = list(vocabulary)

    @F.arrow_udf(f"struct<entities:array<{schemas.ENTITY}>,chunks:int>")
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        find = make_finder()
        for rows in batches:
            data = pc.fill_null(rows.cast(pa.large_binary()), b"")
            at = 0
            lengths = pc.binary_length(data).to_numpy(zero_copy_only=False)
            while at < len(rows):
                # Rows up to the one that fills a part.
                until = at + 1 + int(np.searchsorted(np.cumsum(lengths[at:]), PART_BYTES))
                yield _scan_part(rows.slice(at, until - at), data.slice(at, until - at), find, names, size)
                at = until

    return scan(text)


def _scan_part(rows: pa.Array, texts: pa.Array, find: Finder, names: list[str], size: int) -> pa.Array:
    buffers = texts.buffers()
    places = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = b"" if buffers[2] is None else bytes(memoryview(buffers[2])[places[0] : places[-1]])
    begins = places - places[0]
    present = rows.is_valid().to_numpy(zero_copy_only=False)
    borders, counts = [], np.zeros(len(rows), np.int32)
    for k in np.flatnonzero(present):
        begin, end = int(begins[k]), int(begins[k + 1])
        cuts = chunk_cuts(raw[begin:end], size) if end - begin > size else [0]
        borders.extend([begin + cut for cut in cuts])
        counts[k] = len(cuts)
    bounds = np.array([*borders, len(raw)], np.int64)
    document = np.repeat(np.arange(len(rows)), counts)  # of each chunk
    data = np.frombuffer(raw, np.uint8)
    valid = _is_utf8(raw)
    seen = (data, bounds) if valid else _replaced(raw, bounds)
    parts = [_entities(data, bounds, begins[document], spans, names, valid) for spans in find(*seen) if len(spans[0])]
    found = np.zeros(len(rows) + 1, np.int64)
    for chunk, _ in parts:
        found[1:] += np.bincount(document[chunk], minlength=len(rows))
    kind = pa.struct(_FIELDS)
    entities = pa.concat_arrays([part for _, part in parts]) if parts else pa.array([], kind)
    lists = pa.ListArray.from_arrays(pa.array(np.cumsum(found), pa.int32()), entities)
    return pa.StructArray.from_arrays([lists, pa.array(counts)], names=["entities", "chunks"])


_FIELDS = [
    ("text", pa.string()), ("label", pa.string()), ("score", pa.float32()), ("start", pa.int32()), ("end", pa.int32()),
]


def _is_utf8(raw: bytes) -> bool:
    if raw.isascii():
        return True
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


def _replaced(raw: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chunks as a scorer reads them where bytes aren't UTF-8."""
    chunks = [raw[a:b].decode(errors="replace").encode() for a, b in zip(bounds[:-1], bounds[1:])]
    return np.frombuffer(b"".join(chunks), np.uint8), np.cumsum([0, *map(len, chunks)])


def _entities(
    data: np.ndarray, bounds: np.ndarray, begins: np.ndarray, spans: Spans, names: list[str], valid: bool
) -> tuple[np.ndarray, pa.Array]:
    """Chunk and entity of each distinct span; ``begins`` says where the document of a chunk begins."""
    chunk, label, start, end, score = spans
    if not ((start[1:] > start[:-1]) | (chunk[1:] != chunk[:-1])).all():
        kept = first_of_equal(chunk, start, end, label)
        chunk, label, start, end, score = (x[kept] for x in (chunk, label, start, end, score))
    base = bounds[chunk]
    first, last = base + start, base + end
    sizes = last - first
    whole = last <= bounds[chunk + 1]
    if not valid:
        whole &= np.fromiter((_is_utf8(data[a:b].tobytes()) for a, b in zip(first, last)), bool, len(first))
    elif len(data) and data.max() > 0x7F:
        inside = np.append((data & 0xC0) == 0x80, False)
        whole &= ~inside[np.minimum(first, len(data))] & ~inside[np.minimum(last, len(data))]
    if not whole.all():
        sizes = np.where(whole, sizes, 0)
    ends = np.cumsum(sizes)
    letters = data[np.repeat(first - ends + sizes, sizes) + np.arange(ends[-1])]
    offsets = np.zeros(len(ends) + 1, np.int32)
    offsets[1:] = ends
    shift = base - begins[chunk]
    columns = [
        pa.StringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(letters)),
        pa.array(names, pa.string()).take(pa.array(label)),
        pa.array(score, pa.float32()),
        pa.array((start + shift).astype(np.int32)),
        pa.array((end + shift).astype(np.int32)),
    ]
    return chunk, pa.StructArray.from_arrays(columns, names=[name for name, _ in _FIELDS])


def distinct_rows(rows: DataFrame) -> DataFrame:
    """``distinct_entities`` of many documents at once, over entity rows.

    Rows are as ``entity_rows`` gives them and in its order: a document begins where ``ord`` is 0. What is left of it
    is numbered anew. Beside a batch of rows, only the distinct entities of one document are held.
    """

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[str, int] = {}
        held = [np.empty(0, np.int64)] * 3  # start, end and label of what is kept of the last document
        kept_before = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            document = np.cumsum(batch["ord"].to_numpy() == 0)
            start, end, label = batch["start"], batch["end"], batch["label"].dictionary_encode()
            of = np.array([codes.setdefault(name, len(codes)) for name in label.dictionary.to_pylist()] or [0])
            keys = [pc.fill_null(x, 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (start, end, label.indices)]
            keys[2] = of[keys[2]]
            # An entity without one of the three repeats none.
            whole = pc.and_(pc.and_(start.is_valid(), end.is_valid()), batch["label"].is_valid())
            whole = whole.to_numpy(zero_copy_only=False)
            own = [np.concatenate([old, new[whole]]) for old, new in zip(held, keys)]
            before = len(held[0])
            first = np.ones(batch.num_rows, bool)
            first[whole] = first_of_equal(np.concatenate([np.zeros(before, np.int64), document[whole]]), *own)[before:]

            count = np.bincount(document, weights=first, minlength=document[-1] + 1).astype(np.int64)
            count[0] += kept_before
            begin = np.cumsum(count) - count - kept_before
            place = np.cumsum(first) - 1 - begin[document]
            last = first & whole & (document == document[-1])
            if document[-1]:
                held = [np.empty(0, np.int64)] * 3
            held = [np.concatenate([old, new[last]]) for old, new in zip(held, keys)]
            kept_before = int(count[-1])

            at = batch.schema.get_field_index("ord")
            yield batch.set_column(at, "ord", pa.array(place.astype(np.int32))).filter(pa.array(first))

    return rows.mapInArrow(distinct, rows.schema)
