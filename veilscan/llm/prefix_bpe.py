"""Byte-level BPE by dynamic programming over prefixes, with exact appends and edits.

Every prefix of a piece of text has one encoding, and that of a longer prefix ends with one token whose
predecessor is the last token of what stands before it. So it is enough to keep, for each byte prefix,
its last token: of the tokens that end there, the one that may follow the last token of the prefix
before it. Two tokens may follow each other if merging them by rank never joins bytes across their border.
Tokens are found by one automaton in a single pass; an append goes on from the last prefix, and an edit
is encoded anew only until as many prefixes as the longest token has bytes agree with the old ones.

Texts are cut by a pattern whose classes are those of the library that defines the ids (asked once for
every code point), and each match is encoded by itself. Edits of a text cut and encode only the pieces
around them.

Inputs: a null text is an empty one, without ids. Rows are encoded one by one; other columns pass through,
and a new column raises if there is one of its name. An empty table gives none. No special tokens are known: their strings are plain text.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from veilscan.llm import kernels as K
from veilscan.llm.word_ids import WordIds, ranges

#: Code points that a match may look at behind its end.
LOOKAHEAD = 3
#: Pieces of so many bytes keep the last tokens of their prefixes for later edits.
KEPT_PIECE = 64


def _spans(points: np.ndarray) -> list[tuple[int, int]]:
    """Sorted code points as (first, last) of runs."""
    cut = np.flatnonzero(np.diff(points) != 1) + 1
    return [(int(x[0]), int(x[-1])) for x in np.split(points, cut)] if len(points) else []


@cache
def library_classes() -> dict[str, list[tuple[int, int]]]:
    r"""Code points of \p{L}, \p{N} and \s as the library of the rank files knows them."""
    import tiktoken

    points = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000], np.uint32)
    text = points.tobytes().decode("utf-32-le")
    bare = {bytes([k]): k for k in range(256)}
    out = {}
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        found = tiktoken.Encoding("classes", pat_str=f"{name}+", mergeable_ranks=bare, special_tokens={}).encode_ordinary(text)
        out[name] = _spans(np.frombuffer(bytes(found).decode().encode("utf-32-le"), np.uint32).astype(np.int64))
    return out


def python_pattern(pattern: str, classes: dict[str, list[tuple[int, int]]], limit: int = 0x110000) -> re.Pattern:
    r"""A pattern with \p{L}, \p{N}, \s and \S, for texts whose code points are all below limit."""
    sets = {}
    for name, spans in classes.items():
        own = [(a, min(b, limit - 1)) for a, b in spans if a < limit]
        sets[name] = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in own)
    out, inside, at = [], False, 0
    while at < len(pattern):
        name = next((x for x in (*sets, r"\S") if pattern.startswith(x, at)), None)
        if name == r"\S":
            if inside:
                raise ValueError(r"\S in brackets")
            out.append(f"[^{sets[chr(92) + 's']}]")
        elif name:
            out.append(sets[name] if inside else f"[{sets[name]}]")
        else:
            name = pattern[at : at + 2] if pattern[at] == "\\" else pattern[at]
            inside = inside and name != "]" or name == "["
            out.append(name)
        at += len(name)
    return re.compile("".join(out))


class Splitter:
    """Cuts texts into pieces."""

    def __init__(self, pattern: str, classes: dict[str, list[tuple[int, int]]]) -> None:
        self.patterns = {limit: python_pattern(pattern, classes, limit) for limit in (0x80, 0x100, 0x110000)}

    def limit(self, text: str) -> int:
        """Of 0x80, 0x100 and 0x110000 the least above all code points."""
        if text.isascii():
            return 0x80
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return 0x110000
        return 0x100

    def __call__(self, text: str) -> list[str]:
        return self.patterns[self.limit(text)].findall(text)


class Ranks:
    """Tokens of a rank file, and which of them may follow each other."""

    def __init__(self, tokens: list[bytes]) -> None:
        if len(tokens) > 1 << 16:
            raise ValueError("more than 65,536 tokens")
        self.tokens = tokens
        self.rank = {token: k for k, token in enumerate(tokens) if token}
        if any(bytes([k]) not in self.rank for k in range(256)):
            raise ValueError("a byte has no token")
        self.lengths = np.array([len(token) for token in tokens], np.int64)
        self.longest = int(self.lengths.max())
        # when a token comes to be: single bytes are there from the start
        self.made = [k if len(token) > 1 else -1 for k, token in enumerate(tokens)]
        self.left, self.right = [-1] * len(tokens), [-1] * len(tokens)
        self.reachable: dict[bytes, int] = {}
        self.pairs: dict[int, bool] = {}
        for k, token in enumerate(tokens):
            if len(token) == 1 or token and self._halve(k, token):
                self.reachable[token] = k
        self.automaton = ahocorasick.Automaton()
        for token, k in self.reachable.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), k))
        self.automaton.make_automaton()

    @classmethod
    def of_file(cls, path: str) -> Ranks:
        return cls(tokens_of(path))

    def _halve(self, k: int, token: bytes) -> bool:
        """Find the two tokens that the merges of a token join last; a token that they never make has none."""
        for cut in range(1, len(token)):
            a, b = self.reachable.get(token[:cut], k), self.reachable.get(token[cut:], k)
            if max(a, b) < k or len(token) == 2:
                if self._joins_nothing(a, b, k):
                    self.left[k], self.right[k] = a, b
                    return True
        return False

    def _joins_nothing(self, a: int, b: int, whole: int = -1) -> bool:
        """Whether no merge crosses the border between tokens a and b, but that into whole.

        Goes back in time from the finished tokens: of the two at the border, the one made last is parted.
        A merge across the border comes first if its rank is below that of the merge that takes up the
        left token, and not above that for the right one, as equal ranks are merged from the left.
        """
        never = len(self.tokens)
        end_a = end_b = never
        while True:
            rank = self.rank.get(self.tokens[a] + self.tokens[b])
            if rank is not None and rank != whole and rank < end_a and rank <= end_b:
                return False
            if self.made[a] > self.made[b]:
                end_a, a = self.made[a], self.right[a]
            elif self.made[b] >= 0:
                end_b, b = self.made[b], self.left[b]
            else:
                return True

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the encoding of the two tokens' bytes is these two tokens."""
        key = a << 16 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            known = self.pairs[key] = self._joins_nothing(a, b)
        return known

    def extend(self, last: list[int], data: bytes, old: list[int] | None = None, changed: int = 0) -> int:
        """Append the last tokens of the prefixes of data that follow those in last; returns how many were computed.

        old: last tokens of the prefixes that end with data; from byte `changed` on data's bytes are as there.
        """
        begin, longest, pairs = len(last), self.longest, self.pairs
        shift, same, done = (len(data) - len(old)) if old is not None else 0, 0, begin
        base = max(0, begin - longest)
        found = -1
        for at, (size, token) in self.automaton.iter(data[base:].decode("latin-1") if base else data.decode("latin-1")):
            at += base
            if at < begin or at <= done - 1:
                continue
            if size <= at:
                before = last[at - size]
                ok = pairs.get(before << 16 | token)
                if ok is None:
                    ok = self.may_follow(before, token)
                if not ok:
                    continue
            elif size > at + 1:
                continue
            last.append(token)
            done = at + 1
            if old is not None and at >= changed and at >= shift:
                same = same + 1 if old[at - shift] == token else 0
                if same >= longest:
                    last.extend(old[done - shift :])
                    break
            found = at
        if len(last) != len(data):
            raise AssertionError(f"no token ends prefix {found + 2}")
        return done - begin


    def word(self, data: bytes) -> list[int]:
        """Ids of a whole piece."""
        whole = self.rank.get(data)
        if whole is not None:  # as the library has it, also for a token that no merges make
            return [whole]
        last: list[int] = []
        done, find, add = 0, self.pairs.get, last.append
        for at, (size, token) in self.automaton.iter(data.decode("latin-1")):
            if at < done:
                continue
            if size <= at:
                ok = find(last[at - size] << 16 | token)
                if ok is None:
                    ok = self.may_follow(last[at - size], token)
                if not ok:
                    continue
            add(token)
            done += 1
        return walk_back(self.tokens, last)


class Piece:
    """One piece of text, with the last token of each of its byte prefixes."""

    def __init__(self, ranks: Ranks, data: bytes) -> None:
        self.ranks, self.data, self.last = ranks, data, []
        self.encoded = ranks.extend(self.last, data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.encoded += self.ranks.extend(self.last, self.data)

    def replace(self, start: int, stop: int, new: bytes) -> None:
        """Put new in the place of bytes start to stop."""
        old, self.data = self.last, self.data[:start] + new + self.data[stop:]
        self.last = old[:start]
        self.encoded += self.ranks.extend(self.last, self.data, old, start + len(new))

    def ids(self) -> list[int]:
        whole = self.ranks.rank.get(self.data)
        return [whole] if whole is not None else walk_back(self.ranks.tokens, self.last)


def walk_back(tokens: list[bytes], last: list[int]) -> list[int]:
    """Ids of the whole piece from the last tokens of its prefixes."""
    out, at = [], len(last)
    while at:
        out.append(last[at - 1])
        at -= len(tokens[out[-1]])
    out.reverse()
    return out


class Encoder:
    """Ids of texts; pieces seen before are looked up."""

    def __init__(self, ranks: Ranks, splitter: Splitter) -> None:
        self.ranks, self.split = ranks, splitter
        self.cache = WordIds(self._encode, 600_000)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        own = [self.ranks.word(w.encode()) for w in words]
        return np.fromiter(map(len, own), np.int64, len(own)), np.fromiter(chain.from_iterable(own), np.int64)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        return self.cache([self.split(text) for text in texts])

    def editable(self, texts: list[str]) -> list[EditableText]:
        pieces = [self.split(text) for text in texts]
        ids = self.cache(pieces)
        return [EditableText(self, t, np.fromiter(map(len, p), np.int64, len(p)), x) for t, p, x in zip(texts, pieces, ids, strict=True)]


class EditableText:
    """A text and its ids, kept up under appends and edits; ends: where its pieces end, in code points."""

    def __init__(self, encoder: Encoder, text: str, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.encoder, self.text, self.ids, self.ends = encoder, text, ids.astype(np.int32), np.cumsum(sizes)
        self.limit = encoder.split.limit(text)
        self.kept: dict[int, Piece] = {}  # long pieces by their start, once an edit has met them
        self.encoded = 0

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, stop: int, new: str) -> None:
        """Put new in the place of code points start to stop."""
        start = min(max(start, 0), len(self.text))
        stop = min(max(stop, start), len(self.text))
        old, shift = self.text, len(new) - (stop - start)
        self.text = old[:start] + new + old[stop:]
        ends = self.ends
        k = int(np.searchsorted(ends, start - LOOKAHEAD + 1))  # pieces that end before haven't seen the change
        begin = int(ends[k - 1]) if k else 0
        fresh: list[tuple[int, int]] = []
        j = len(ends)  # old pieces from j on stay
        self.limit = max(self.limit, self.encoder.split.limit(new))
        for found in self.encoder.split.patterns[self.limit].finditer(self.text, begin):
            fresh.append(found.span())
            at = found.end()
            if at >= start + len(new):
                same = int(np.searchsorted(ends, at - shift))
                if same < len(ends) and ends[same] == at - shift:
                    j = same + 1
                    break
        first = begin, int(ends[k]) if k < len(ends) else begin
        tail = int(ends[j - 1]) if j else 0
        own = [self._encode(a, b, first, old, start, stop) for a, b in fresh]
        kept = {a + (shift if a >= tail else 0): x for a, x in self.kept.items() if a < begin or a >= tail}
        self.kept = kept | {a: x for (a, _), (_, x) in zip(fresh, own, strict=True) if x}
        id_ends = np.cumsum(self.encoder.ranks.lengths[self.ids])  # in bytes
        size = len(old[:begin].encode())
        head, rest = np.searchsorted(id_ends, [size, size + len(old[begin:tail].encode())], "right") if tail > begin else [len(self.ids)] * 2
        self.ids = np.concatenate([self.ids[:head], *[np.asarray(ids, np.int32) for ids, _ in own], self.ids[rest:]])
        self.ends = np.concatenate([ends[:k], np.array([b for _, b in fresh], np.int64), ends[j:] + shift])

    def _encode(self, a: int, b: int, first: tuple[int, int], old: str, start: int, stop: int) -> tuple[list[int] | np.ndarray, Piece | None]:
        """Ids of the new piece from a to b; a long one that was there before is encoded near the edit only.

        first: span of the first old piece that may change, in the text old, of which start to stop went.
        """
        word = self.text[a:b]
        if len(word) < KEPT_PIECE:
            self.encoded += len(word.encode())
            return self.encoder.ranks.word(word.encode()), None
        after = word.encode()
        if first[0] == a and first[1] - a >= KEPT_PIECE:
            piece = self.kept.get(a) or Piece(self.encoder.ranks, old[a : first[1]].encode())
            piece.encoded = 0
            size = min(len(piece.data), len(after))
            left = min(len(old[a : min(start, first[1], b)].encode()), size)  # bytes that stay in front, and behind
            tail = old[stop : first[1]]
            right = min(len(tail.encode()), size - left) if tail and word.endswith(tail) else 0
            piece.replace(left, len(piece.data) - right, after[left : len(after) - right])
        else:
            piece = Piece(self.encoder.ranks, after)
        self.encoded += piece.encoded
        return piece.ids(), piece


@cache
def tokens_of(path: str) -> list[bytes]:
    with open(path, "rb") as file:
        rows = [line.split() for line in file if line.strip()]
    tokens = [b""] * (1 + max(int(k) for _, k in rows))
    for token, k in rows:
        tokens[int(k)] = base64.b64decode(token)
    return tokens


@cache
def ranks_of(path: str) -> Ranks:
    """One for each Python worker, which runs many tasks."""
    return Ranks.of_file(path)


_splitters: dict[str, Splitter] = {}


def encoder_of(path: str, pattern: str, classes: dict[str, list[tuple[int, int]]]) -> Encoder:
    if pattern not in _splitters:
        _splitters[pattern] = Splitter(pattern, classes)
    return Encoder(ranks_of(path), _splitters[pattern])


def _lists(ids: list) -> pa.Array:
    ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
    flat = np.concatenate([np.asarray(x, np.int32) for x in ids]) if ids else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _added(df: DataFrame, **columns: T.DataType) -> T.StructType:
    taken = {x.lower() for x in df.columns}
    for name in columns:
        if name.lower() in taken:
            raise ValueError(f"there is a column {name} already")
    return T.StructType([*df.schema.fields, *[T.StructField(name, kind) for name, kind in columns.items()]])


def encode(docs: DataFrame, ranks: str, pattern: str = public_tokenizers.PATTERN, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """All rows and columns, and ids: an array of numbers."""
    schema, position, classes = _added(docs, **{ids_col: T.ArrayType(T.IntegerType())}), docs.columns.index(text_col), library_classes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(ranks, pattern, classes)
        for batch in (part for whole in batches for part in K.slices(whole, position, 2 * K.BLOCK)):
            ids = encoder([x or "" for x in batch.column(position).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(ids)], names=schema.names)

    return docs.mapInArrow(run, schema)


def encode_edited(
    docs: DataFrame, ranks: str, edits_col: str, pattern: str = public_tokenizers.PATTERN, text_col: str = "text",
    ids_col: str = "ids", edited_col: str = "edited_ids", encoded_col: str = "encoded_bytes",
) -> DataFrame:
    """All rows and columns, ids of the text, ids of it after its edits, and how many bytes were encoded for these.

    edits_col: array of (start, stop, text), applied one after the other: text in the place of code points
    start to stop of the text so far; positions beyond an end mean that end. Null edits, or null fields, change nothing.
    """
    schema = _added(docs, **{ids_col: T.ArrayType(T.IntegerType()), edited_col: T.ArrayType(T.IntegerType()), encoded_col: T.LongType()})
    position, spot, classes = docs.columns.index(text_col), docs.columns.index(edits_col), library_classes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(ranks, pattern, classes)
        for batch in (part for whole in batches for part in K.slices(whole, position, 2 * K.BLOCK)):
            ids, edited, encoded = [], [], []
            texts = encoder.editable([x or "" for x in batch.column(position).to_pylist()])
            for kept, edits in zip(texts, batch.column(spot).to_pylist(), strict=True):
                ids.append(kept.ids)
                for edit in edits or []:
                    if edit is not None and None not in edit.values():
                        kept.replace(edit["start"], edit["stop"], edit["text"])
                edited.append(kept.ids)
                encoded.append(kept.encoded)
            columns = [*batch.columns, _lists(ids), _lists(edited), pa.array(encoded, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, ranks: str, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """All rows and columns, and the bytes of the ids. Null ids: null."""
    schema, position = _added(rows, **{decoded_col: T.BinaryType()}), rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(ranks)
        lengths = np.array([len(x) for x in tokens], np.int64)
        data, starts = np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(lengths) - lengths
        for batch in batches:
            out = []
            for ids in batch.column(position):
                if ids.is_valid:
                    ids = ids.values.to_numpy()
                    out.append(data[ranges(starts[ids], lengths[ids])].tobytes())
                else:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=schema.names)

    return rows.mapInArrow(run, schema)
