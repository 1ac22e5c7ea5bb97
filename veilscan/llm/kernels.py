"""Hashes of words, shingles and characters, for whole blocks of texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text that are worked on at a time; a longer text is cut at white space.
BLOCK = 1 << 20
_BASE = U(0x9E3779B97F4A7C15)
_SALT = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
PLACES = np.random.default_rng(12).integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: White space and, beside it, ASCII marks.
_MARKS = _SPACE.copy()
_MARKS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> U(31))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(32)
    return h


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(20, (n + 1).bit_length())
    if size not in _powers:
        up, down = np.full(size, _BASE), np.full(size, U(pow(int(_BASE), -1, 2**64)))
        up[0] = down[0] = U(1)
        _powers.clear()
        _powers[size] = (np.cumprod(up), np.cumprod(down))
    return _powers[size]


def _block_words(raw: np.ndarray, marks: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of lower-cased bytes."""
    space = np.empty(len(raw) + 2, bool)
    space[0] = space[-1] = True
    space[1:-1] = (_MARKS if marks else _SPACE)[raw]
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[0::2], edges[1::2]
    up, down = _power(len(raw))
    sums = np.zeros(len(raw) + 1, U)
    np.cumsum(_SALT[_LOWER[raw]] * up[: len(raw)], out=sums[1:])
    return starts, mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))


def word_hashes(raw: bytes | np.ndarray, marks: bool = False) -> np.ndarray:
    """Hashes of the words of one UTF-8 text, A-Z in lower case; words are parted by ASCII white space, or by marks too."""
    raw = np.frombuffer(raw, np.uint8)
    parts, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + BLOCK)
        while end < len(raw):  # don't cut a word
            gaps = np.flatnonzero(_SPACE[raw[end : end + BLOCK]])
            if len(gaps):
                end += int(gaps[0])
                break
            end = min(len(raw), end + BLOCK)
        parts.append(_block_words(raw[at:end], marks)[1])
        at = end
    return np.concatenate(parts) if parts else np.empty(0, U)


def string_buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; a null is an empty text."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_string()).fill_null("")
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    return at, np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)


def words_of(array: pa.Array, marks: bool = False) -> Iterator[np.ndarray]:
    """Word hashes of each text of a column, in blocks of many short texts or one long one."""
    at, raw = string_buffers(array)
    k = 0
    while k < len(at) - 1:
        end = max(k + 1, int(np.searchsorted(at, at[k] + BLOCK, "right")) - 1)
        if at[end] - at[k] > BLOCK:
            yield word_hashes(raw[at[k] : at[end]], marks)
        else:  # a space after each text keeps words apart
            cut, own = at[k : end + 1] - at[k], raw[at[k] : at[end]]
            padded = np.insert(own, cut[1:], 32) if end - k > 1 else own
            starts, hashes = _block_words(padded, marks)
            yield from np.split(hashes, np.searchsorted(starts, (cut + np.arange(len(cut)))[1:-1]))
        k = end


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; of a shorter text, one of all its words; of none, none."""
    if not len(words):
        return words
    k = min(n, len(words))
    total = np.full(len(words) - k + 1, U(k)) * PLACES[63]
    for j in range(k):
        total += words[j : len(words) - k + 1 + j] * PLACES[j]
    return mix(total)


def set_key(hashes: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that name a set of distinct hashes."""
    with np.errstate(over="ignore"):
        return int(mix(hashes ^ _BASE).sum(dtype=U)), int(mix(hashes * PLACES[61] + U(len(hashes))).sum(dtype=U))


def binary_keys(high: np.ndarray, low: np.ndarray) -> pa.Array:
    """Pairs of 64-bit numbers as 16-byte values."""
    data = np.stack([np.asarray(high, U), np.asarray(low, U)], 1).tobytes()
    offsets = np.arange(0, 16 * len(high) + 1, 16, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(high), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def slices(batch: pa.RecordBatch, column: str | int, limit: int = 16 * BLOCK) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that hold so many bytes of text at most, or one row."""
    at, _ = string_buffers(batch[column])
    k = 0
    while k < batch.num_rows:
        end = max(k + 1, int(np.searchsorted(at, at[k] + limit, "right")) - 1)
        yield batch.slice(k, end - k)
        k = end
