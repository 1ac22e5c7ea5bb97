"""Byte-level BPE: a minimal acyclic transducer for frequent words, exact merges for the others.

The transducer takes the bytes of a word. Words that end alike share their last states; the numbers
put out along a path add up to the word's place in a list of id sequences. Its arcs are sorted arrays
in one file image, which each Python worker maps into memory, and many words walk it at a time.
Words that it doesn't hold are merged, many at a time too, always at the pair of least rank. Either
way gives the ids of the tokenizer file's library, hence the choice of frequent words only steers speed.

Inputs: a null text is an empty one, without ids. Special tokens that stand in a text are ids of
their own, as the library has it. Rows are encoded one by one; other columns pass through.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import tempfile
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilscan.llm import kernels as K
from veilscan.llm.store import write_table
from veilscan.llm.word_ids import LATIN_LETTERS, LATIN_NUMBERS, LATIN_WHITE, WHITE, WordIds, is_latin, ranges

#: Words in the transducer, and bytes of the longest: at most 3.2 million states. Longer words are merged.
FREQUENT = 50_000
LONGEST = 64
#: Words of more bytes are merged one at a time.
LONG_WORD = 1000

_PLAIN = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.A)
_LATIN = re.compile(
    f"'(?:[sdmt]|ll|ve|re)| ?[{LATIN_LETTERS}]+| ?[{LATIN_NUMBERS}]+| ?[^{LATIN_WHITE}{LATIN_LETTERS}{LATIN_NUMBERS}]+"
    f"|[{LATIN_WHITE}]+(?![^{LATIN_WHITE}])|[{LATIN_WHITE}]+"
)
_WORDS = regex.compile(
    rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}++| ?\p{{N}}++| ?[^{WHITE}\p{{L}}\p{{N}}]++|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
)


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, then from 256 up."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


class Vocabulary:
    """Tokens and merges of a tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        ids = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.bytes = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        for token, k in ids.items():
            self.bytes[k] = bytes(letters[x] for x in token)
        for token, k in self.special.items():
            self.bytes[k] = token.encode()
        self.single = np.zeros(256, np.int64)
        for token, k in ids.items():
            if len(token) == 1:
                self.single[letters[token]] = k
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        pairs = np.array([ids[a] << 32 | ids[b] for a, b in merges], np.int64)
        made = np.array([ids[a + b] for a, b in merges], np.int64)
        order = np.argsort(pairs)
        self.pairs, self.ranks, self.made = pairs[order], order, made[order]

    def words(self, text: str) -> list[str]:
        find = _PLAIN if text.isascii() else _LATIN if is_latin(text) else _WORDS
        if self.split is None or not any(x in text for x in self.special):
            return find.findall(text)
        parts = self.split.split(text)
        return [w for k, part in enumerate(parts) for w in ([part] if k % 2 else find.findall(part))]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids of words, by merging the pair of least rank until none is left."""
        long = [k for k, w in enumerate(words) if len(w) > LONG_WORD]
        if not long:
            return self._merge_short(words)
        lengths, ids = self._merge_short([b"" if len(w) > LONG_WORD else w for w in words])
        parts = np.split(ids, np.cumsum(lengths)[:-1])
        for k in long:
            parts[k] = self.merge_long(words[k])
            lengths[k] = len(parts[k])
        return lengths, np.concatenate(parts)

    def merge_long(self, word: bytes) -> np.ndarray:
        """Ids of one long word: a heap of ranks, each with the places of its pairs, over a linked list.

        What a merge makes has a higher rank than the merge, so all places of a rank are merged at once.
        """
        ids = self.single[np.frombuffer(word, np.uint8)]
        n = len(ids)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        places: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def offer(left: np.ndarray) -> None:
            left = left[after[left] < n]
            key = ids[left] << 32 | ids[after[left]]
            at = np.searchsorted(self.pairs, key)
            at[at == len(self.pairs)] = 0
            known = self.pairs[at] == key
            at, left = at[known], left[known]
            order = np.argsort(at, kind="stable")
            at, left = at[order], left[order]
            cuts = np.flatnonzero(np.diff(at)) + 1
            starts = [0, *cuts.tolist(), len(at)] if len(at) else []
            for a, b in zip(starts, starts[1:], strict=False):
                rank = int(self.ranks[at[a]])
                if rank not in places:
                    places[rank] = []
                    heapq.heappush(heap, rank)
                places[rank].append(left[a:b])

        by_rank = np.empty(len(self.ranks), np.int64)
        by_rank[self.ranks] = np.arange(len(self.ranks))
        offer(np.arange(n - 1))
        while heap:
            rank = heapq.heappop(heap)
            spot = by_rank[rank]
            first, second = self.pairs[spot] >> 32, self.pairs[spot] & 0xFFFFFFFF
            left = np.unique(np.concatenate(places.pop(rank)))
            left = left[(ids[left] == first) & (after[left] < n)]
            left = left[ids[after[left]] == second]
            if first == second and len(left) > 1:  # of pairs in a row, which overlap, every other one counts
                begins = np.flatnonzero(np.append(True, after[left[:-1]] != left[1:]))
                turn = np.arange(len(left)) - np.repeat(begins, np.diff(np.append(begins, len(left))))
                left = left[turn % 2 == 0]
            if not len(left):
                continue
            right = after[left]
            ids[left], ids[right] = self.made[spot], -1
            after[left] = after[right]
            inner = left[after[left] < n]
            before[after[inner]] = inner
            offer(np.unique(np.concatenate([left, before[left][before[left] >= 0]])))
        return ids[ids >= 0]

    def _merge_short(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(w) for w in words], np.int64)
        ids = self.single[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            key = ids[:-1] << 32 | ids[1:]
            at = np.searchsorted(self.pairs, key)
            at[at == len(self.pairs)] = 0
            known = (self.pairs[at] == key) & (owner[:-1] == owner[1:]) if len(key) else np.empty(0, bool)
            rank = np.append(np.where(known, self.ranks[at], 1 << 40), 1 << 40)
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(owner))))
            live = best < 1 << 40
            if not live.all():
                done.append((owner[~live], ids[~live]))
            hit = np.flatnonzero(live & (rank == best))
            if len(hit):  # of hits in a row, which overlap, every other one counts
                first = np.flatnonzero(np.diff(hit, prepend=-2) != 1)
                turn = np.arange(len(hit)) - np.repeat(first, np.diff(np.append(first, len(hit))))
                hit = hit[turn % 2 == 0]
                ids[hit] = self.made[at[hit]]
                live[hit + 1] = False
            ids, owner = ids[live], owner[live]
        if not done:
            return np.zeros(len(words), np.int64), np.empty(0, np.int64)
        owner, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(owner, kind="stable")
        return np.bincount(owner, minlength=len(words)), ids[order]


@cache
def vocabulary_of(path: str) -> Vocabulary:
    """One for each Python worker, which runs many tasks."""
    return Vocabulary(path)


def build_lexicon(words: list[bytes], vocabulary: Vocabulary) -> bytes:
    """The file image of the transducer of words: arrays one after the other, behind their sizes."""
    words = sorted(set(words))
    lengths, ids = vocabulary.merge(words)
    register: dict[tuple, int] = {}
    states: list[tuple] = []  # (final, ((byte, state), ...)) of minimal states
    path: list[list] = [[False, []]]  # of the word last put in: final, arcs; the state under the last arc is still open

    def close(depth: int) -> None:
        while len(path) > depth:
            final, arcs = path.pop()
            state = (final, tuple(arcs))
            if state not in register:
                register[state] = len(states)
                states.append(state)
            path[-1][1][-1] = (path[-1][1][-1][0], register[state])

    last = b""
    for word in words:
        same = len(os.path.commonprefix([last, word]))
        close(same + 1)
        for byte in word[same:]:
            path[-1][1].append((byte, -1))
            path.append([False, []])
        path[-1][0] = True
        last = word
    close(1)
    states.append((path[0][0], tuple(path[0][1])))
    below = np.zeros(len(states), np.int64)  # words that end at or under a state; a state stands behind those under it
    keys, targets, outputs = [], [], []
    for k, (final, arcs) in enumerate(states):
        count = int(final)
        for byte, target in arcs:
            keys.append(k << 8 | byte), targets.append(target), outputs.append(count)
            count += below[target]
        below[k] = count
    finals = np.array([x[0] for x in states], np.int64)
    if len(states) >= 1 << 23:
        raise ValueError("too many states for 32-bit keys")
    arrays = [np.array(x, np.int32) for x in (keys, targets, outputs, finals, np.cumsum(lengths) - lengths, lengths, ids)]
    return b"".join([np.array([len(x) for x in arrays], np.int32).tobytes(), *(x.tobytes() for x in arrays)])


class Lexicon:
    """A transducer mapped into memory."""

    def __init__(self, image: np.ndarray) -> None:
        sizes = image[:7]
        ends = 7 + np.cumsum(sizes)
        self.keys, self.targets, self.outputs, self.finals, self.starts, self.lengths, self.ids = (
            image[e - n : e] for e, n in zip(ends, sizes, strict=True)
        )

    @classmethod
    def mapped(cls, data: bytes) -> Lexicon:
        """From a copy in the worker's own temporary folder, made anew where it is missing."""
        path = os.path.join(tempfile.gettempdir(), f"lexicon-{hashlib.sha256(data).hexdigest()[:24]}")
        if not os.path.exists(path):
            with open(f"{path}-{os.getpid()}", "wb") as file:
                file.write(data)
            os.replace(file.name, path)
        return cls(np.memmap(path, np.int32, "r"))

    def find(self, words: list[bytes]) -> np.ndarray:
        """Places of words in the list of id sequences, -1 for unknown ones."""
        out = np.full(len(words), -1)
        if not len(self.keys):
            return out
        lengths = np.array([len(w) for w in words], np.int64)
        starts, data = np.cumsum(lengths) - lengths, np.frombuffer(b"".join(words), np.uint8)
        own, state = np.arange(len(words)), np.full(len(words), len(self.finals) - 1)
        total, depth = np.zeros(len(words), np.int64), 0
        while len(own):
            ended = lengths[own] == depth
            hit = own[ended & (self.finals[state] == 1)]
            out[hit] = total[hit]
            own, state = own[~ended], state[~ended]
            key = (state << 8 | data[starts[own] + depth]).astype(np.int32)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[at] == key
            own, at = own[known], at[known]
            total[own] += self.outputs[at]
            state, depth = self.targets[at], depth + 1
        return out


class Encoder:
    """Ids of texts by lexicon and merges."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon) -> None:
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.cache = WordIds(self._encode)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        special = self.vocabulary.special
        data = [w.encode() for w in words]
        place = self.lexicon.find(data)
        for k, word in enumerate(words):
            if word in special:
                place[k] = -2
        unseen, seen = np.flatnonzero(place == -1), np.flatnonzero(place >= 0)
        lengths = np.ones(len(words), np.int64)
        merged, merged_ids = self.vocabulary.merge([data[k] for k in unseen])
        lengths[unseen], lengths[seen] = merged, self.lexicon.lengths[place[seen]]
        kind = np.repeat(np.minimum(place, 0), lengths)
        ids = np.empty(len(kind), np.int64)
        ids[kind == -1] = merged_ids
        ids[kind == 0] = self.lexicon.ids[ranges(self.lexicon.starts[place[seen]].astype(np.int64), lengths[seen])]
        ids[kind == -2] = [special[w] for w in words if w in special]
        return lengths, ids

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        return self.cache([self.vocabulary.words(text) for text in texts])


def frequent_words(docs: DataFrame, tokenizer: str, count: int = FREQUENT, text_col: str = "text") -> list[bytes]:
    """About count of the most frequent words of all texts, without those of more than LONGEST bytes.

    No more than these reach the driver: the least size that leaves so many is found first, and of words of that size a share by hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, counts = vocabulary_of(tokenizer), Counter()

        def take() -> pa.RecordBatch:
            rows = pa.record_batch({"word": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})
            counts.clear()
            return rows

        for batch in batches:
            for text in batch["text"].to_pylist():
                counts.update(w for w in vocabulary.words(text) if len(w) <= LONGEST and len(w.encode()) <= LONGEST)
                if len(counts) > 500_000:
                    yield take()
        yield take()

    rows = docs.select(F.col(text_col).cast("string").alias("text")).filter("text is not null")
    counts = write_table(rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    # words by size class, about 16 classes for each doubling; as many classes as fit, and of the next one a share
    size = F.floor(F.log2("n") * 16)
    classes = counts.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("words")).collect()
    least, left = 0, count
    for own in sorted(classes, key=lambda x: -x.size):
        least = own.size
        if own.words > left:
            break
        left -= own.words
    else:
        own = None
    kept = size > least if own else F.lit(True)
    if own and left:
        kept |= (size == least) & (F.pmod(F.xxhash64("word"), F.lit(own.words)) < left)
    return [row.word.encode() for row in counts.filter(kept).select("word").collect()]


def encode(docs: DataFrame, tokenizer: str, count: int = FREQUENT, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """All rows and columns, and ids: little-endian unsigned 32-bit numbers."""
    if ids_col in docs.columns:
        raise ValueError(f"there is a column {ids_col} already")
    position = docs.columns.index(text_col)
    words = frequent_words(docs, tokenizer, count, text_col)
    image = docs.sparkSession.sparkContext.broadcast(build_lexicon(words, vocabulary_of(tokenizer)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary_of(tokenizer), Lexicon.mapped(image.value))
        for batch in (part for whole in batches for part in K.slices(whole, position, 2 * K.BLOCK)):
            ids = encoder([x or "" for x in batch.column(position).to_pylist()])
            ids = pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, ids_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(ids_col, T.BinaryType())]))


def decode(rows: DataFrame, tokenizer: str, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """All rows and columns, and the text of the ids; bytes that are no UTF-8 become U+FFFD. Null ids: null."""
    if decoded_col in rows.columns:
        raise ValueError(f"there is a column {decoded_col} already")
    position = rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary_of(tokenizer).bytes
        lengths = np.array([len(x) for x in tokens], np.int64)
        data, starts = np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(lengths) - lengths
        for batch in batches:
            out = []
            for ids in batch.column(position):
                if ids.is_valid:
                    ids = np.frombuffer(ids.as_buffer(), "<u4")
                    out.append(data[ranges(starts[ids], lengths[ids])].tobytes().decode("utf-8", "replace"))
                else:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, decoded_col])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(decoded_col, T.StringType())]))
