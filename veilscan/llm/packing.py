"""Packing along a space-filling curve.

A document's token counts are a hashed vector (one place for each id); a fixed random projection
takes it to DIMS numbers, each of which is put on a grid of 2**BITS steps. The Hilbert index of the
grid cell is the document's place on the curve. Documents are range-sorted by it, and each sorted
partition is cut into sequences: a document goes on in the next sequence where one is full. The rest
at the end of a partition is cut into sequences whose lengths are powers of two, so that no sequence
needs padding.

A place on the curve that many documents share is split over partitions by a hash of the document.
Ids are those of a tokenizer file in which words are encoded one by one (a normaliser to lower case
and NFC, a split into words, then BPE with word ends), and end_id at the end. Letters, numbers and white
space are what the file's library takes for them; it normalises texts of newer code points itself.

Inputs: a null or empty text is the end_id alone. Rows that repeat an id are packed as documents of
their own, and a null id stays null. Other columns are not read. An empty table gives no pieces.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.llm import kernels as K
from veilscan.llm.store import text_or_empty, write_table
from veilscan.llm.word_ids import WordIds, is_latin

DIMS, BITS = 3, 10
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"

_SIGMA = "Σ"


def _spans(points: np.ndarray) -> list[tuple[int, int]]:
    """Sorted code points as (first, last) of runs."""
    cut = np.flatnonzero(np.diff(points) != 1) + 1
    return [(int(x[0]), int(x[-1])) for x in np.split(points, cut)] if len(points) else []


@cache
def library_characters(path: str) -> dict[str, list[tuple[int, int]]]:
    """Code points, asked of the tokenizer file's library: letters, numbers, white space, and odd ones.

    A text without odd ones is normalised here as there: all its code points are old enough that every
    version of Unicode treats them alike, together too, and each by itself was compared.
    """
    from tokenizers import Regex, Tokenizer, pre_tokenizers

    points = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000], np.uint32)
    text = points.tobytes().decode("utf-32-le")
    out = {}
    for name, kind in (("letters", r"\p{L}"), ("numbers", r"\p{N}"), ("white", r"\s")):
        found = pre_tokenizers.Split(Regex(f"{kind}+"), "removed", invert=True).pre_tokenize_str(text)
        own = "".join(part for part, _ in found)
        out[name] = _spans(np.frombuffer(own.encode("utf-32-le"), np.uint32).astype(np.int64))
    white = {c for a, b in out["white"] for c in range(a, b + 1)}
    normalize, old = Tokenizer.from_file(path).normalizer.normalize_str, unicodedata.ucd_3_2_0.category
    odd = [c for c, x in zip(points.tolist(), text, strict=True) if c not in white and (old(x) == "Cn" or normalize(x) != _normalized(x))]
    out["odd"] = _spans(np.array(odd, np.int64))
    assert not odd or odd[0] > 0xFF
    return out


def _normalized(text: str) -> str:
    text = unicodedata.normalize("NFC", text)
    if _SIGMA in text:  # str.lower() has a rule for the ends of words
        text = text.replace(_SIGMA, "σ")
    return text.lower()


class WordTokenizer:
    """Ids of texts by a tokenizer file, as its library gives them without special tokens added.

    characters: those of library_characters().
    """

    def __init__(self, path: str, characters: dict[str, list[tuple[int, int]]]) -> None:
        from tokenizers import Tokenizer, normalizers

        self.bare = Tokenizer.from_file(path)
        self.normalizer = self.bare.normalizer
        self.special = {t.content: k for k, t in self.bare.get_added_tokens_decoder().items()}
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.no_truncation()
        self.bare.no_padding()
        vocabulary = self.bare.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(1 << 16, bool)
        self.ends[[k for word, k in vocabulary.items() if word.endswith("</w>")]] = True
        self.cache = WordIds(self._encode, 150_000)
        limits = (0x80, 0x100, 0x110000)
        sets = [{k: "".join(f"\\U{a:08x}-\\U{min(b, n - 1):08x}" for a, b in v if a < n) for k, v in characters.items()} for n in limits]
        self.patterns = [
            re.compile("'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{white}{letters}{numbers}]+".format(**own)) for own in sets
        ]
        self.odd = re.compile(f"[{sets[-1]['odd']}]")

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out: list[np.ndarray] = [np.empty(0, np.int64)]
        lengths = np.ones(len(words), np.int64)
        plain = [k for k, word in enumerate(words) if word not in self.special]
        blocks = [" ".join(words[k] for k in plain[at : at + 256]) for at in range(0, len(plain), 256)]
        ids = [np.array(e.ids) for e in self.bare.encode_batch(blocks, add_special_tokens=False)]
        ids = np.concatenate(ids) if ids else out[0]
        last = np.flatnonzero(self.ends[ids])
        if len(last) == len(plain):
            lengths[plain] = np.diff(last, prepend=-1)
        else:  # words that the library parts otherwise, one by one
            each = [e.ids for e in self.bare.encode_batch([words[k] for k in plain], add_special_tokens=False)]
            lengths[plain] = [len(x) for x in each]
            ids = np.array([x for own in each for x in own], np.int64)
        flat = np.empty(lengths.sum(), np.int64)
        own = np.repeat(np.array([w in self.special for w in words], bool), lengths)
        flat[~own], flat[own] = ids, [self.special[w] for w in words if w in self.special]
        return lengths, flat

    def _words(self, text: str) -> list[str]:
        if text.isascii():
            return self.patterns[0].findall(text.lower())
        odd = not is_latin(text) and self.odd.search(text)  # no code point of Latin-1 is odd
        text = self.normalizer.normalize_str(text) if odd else _normalized(text)
        return self.patterns[1 if is_latin(text) else 2].findall(text)

    def words(self, text: str) -> list[str]:
        if "<|" not in text:
            return self._words(text)
        return [w for k, part in enumerate(self.split.split(text)) for w in ([part] if k % 2 else self._words(part))]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        return self.cache([self.words(text) for text in texts])


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer_of(path: str, characters: dict[str, list[tuple[int, int]]]) -> WordTokenizer:
    """One for each Python worker, which runs many tasks."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path, characters)
    return _tokenizers[path]


def projection(size: int) -> np.ndarray:
    """For each hashed place of the vector, its DIMS coordinates."""
    return np.random.default_rng(10).standard_normal((size, DIMS)).astype(np.float32)


def grid_cells(ids: list[np.ndarray], table: np.ndarray) -> np.ndarray:
    """Grid cells of documents given as ids."""
    points = np.zeros((len(ids), DIMS))
    for k, own in enumerate(ids):
        places, counts = np.unique(own, return_counts=True)
        weights = 1 + np.log(counts)
        points[k] = weights @ table[places] / (np.sqrt(weights @ weights) or 1)
    steps = 1 << BITS
    return np.clip((np.tanh(points / 2) + 1) / 2 * steps, 0, steps - 1).astype(np.int64)


def hilbert_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places of grid cells along the Hilbert curve, by the exchange and inversion of axes from the top bit down."""
    x = [cells[:, k].copy() for k in range(cells.shape[1])]
    n = len(x)
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for k in range(n):
            up = (x[k] >> bit) & 1 == 1
            swap = np.where(up, 0, (x[0] ^ x[k]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            x[k] = x[k] ^ swap
    for k in range(1, n):
        x[k] ^= x[k - 1]
    flip = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where((x[n - 1] >> bit) & 1 == 1, (1 << bit) - 1, 0)
    out = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for k in range(n):
            out = out << 1 | ((x[k] ^ flip) >> bit) & 1
    return out


class _Packer:
    """Cuts documents that come in order into sequences."""

    def __init__(self, first_id: int, length: int) -> None:
        self.id, self.length, self.fill = first_id, length, 0
        self.open: list[tuple] = []
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            part = ids[at : at + self.length - self.fill]
            self.open.append((doc_id, at, part, len(ids)))
            at, self.fill = at + len(part), self.fill + len(part)
            if self.fill == self.length:
                self.close(self.length)

    def close(self, length: int) -> None:
        """Put out the first so many open ids as a sequence."""
        offset, left = 0, []
        for doc_id, start, ids, total in self.open:
            own = ids[: length - offset]
            if len(own):
                self.rows.append((doc_id, start, len(own), total, self.id, offset, own.astype("<u4").tobytes()))
                offset += len(own)
            if len(own) < len(ids):
                left.append((doc_id, start + len(own), ids[len(own) :], total))
        self.open, self.fill, self.id = left, self.fill - length, self.id + 1

    def finish(self) -> None:
        while self.fill:
            self.close(1 << (self.fill.bit_length() - 1))

    def take(self) -> pa.RecordBatch:
        kinds = [*[pa.int64()] * 6, pa.binary()]
        columns = list(zip(*self.rows, strict=True)) or [()] * 7
        self.rows = []
        names = [x.split()[0] for x in PIECES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def placed_documents(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, place, ids) of every document; ids: little-endian unsigned 16-bit numbers."""
    characters = library_characters(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, table = tokenizer_of(tokenizer, characters), projection(1 << 16)
        for batch in (part for whole in batches for part in K.slices(whole, "text", 2 * K.BLOCK)):
            ids = [np.append(x, np.uint16(end_id)) for x in encode(batch["text"].to_pylist())]
            yield pa.record_batch(
                {
                    "doc_id": batch["doc_id"],
                    "place": pa.array(hilbert_index(grid_cells(ids, table))),
                    "ids": pa.array([x.astype("<u2").tobytes() for x in ids], pa.binary()),
                }
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, place long, ids binary")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents in sequences of at most length ids; ids: little-endian unsigned 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(TaskContext.get().partitionId() << 40, length)
        for batch in batches:
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), batch["ids"], strict=True):
                packer.add(doc_id, np.frombuffer(ids.as_buffer(), "<u2"))
                if len(packer.rows) >= 2000:
                    yield packer.take()
        packer.finish()
        yield packer.take()

    placed = write_table(placed_documents(docs, tokenizer, end_id, id_col, text_col), "placed")
    placed = placed.withColumn("turn", F.xxhash64("doc_id", "ids"))
    ordered = placed.repartitionByRange("place", "turn").sortWithinPartitions("place", "turn", "doc_id").select("doc_id", "ids")
    return ordered.mapInArrow(run, PIECES)
