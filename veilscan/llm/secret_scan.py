"""Secret scans: a keyword automaton finds where to look, anchored patterns look there, checksums decide.

The automaton runs over the text with A-Z in lower case. A pattern is tried only at the place of a
keyword's hit, and never before the end of the kind's last match, which gives the same leftmost
matches as a search of the whole text. Long runs of hexadecimal digits have no keyword; the bytes at
every HEX_RUN-th place tell where one can be.

Kinds beyond the base ones are tokens with an embedded checksum, reported only if it holds: six
characters (CRC-32 of the thirty before, in base 62) behind the prefix.

Inputs: a null text has no spans. Rows are scanned one by one, so copies, ties and order don't
matter; all columns pass through, and spans_col must not clash with one of them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from veilscan.llm import kernels as K

#: The base kinds in their order, with their patterns and least lengths.
BASE = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
VALUE, ACCESS_LENGTH, HEX_RUN = 8, 16, 32
#: Prefixes of tokens with an embedded checksum.
CHECKED = {"github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "npm": ("npm_",)}
CHECKED_BODY = re.compile(r"[A-Za-z0-9]{36}(?![A-Za-z0-9])")
KINDS = (*BASE, *CHECKED)
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_IS_HEX = np.zeros(256, bool)
_IS_HEX[list(b"0123456789abcdef")] = True


def checksum(body: str) -> str:
    """CRC-32 as six base-62 digits."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, digit = divmod(n, 62)
        out = DIGITS[digit] + out
    return out


@cache
def _automaton() -> ahocorasick.Automaton:
    words = {w: "assign" for w in ("password", "passwd", "secret", "token", "apikey", "api_key")} | {"akia": "access"}
    words |= {w: kind for kind, prefixes in CHECKED.items() for w in prefixes}
    automaton = ahocorasick.Automaton()
    for word, kind in words.items():
        automaton.add_word(word, (kind, len(word)))
    automaton.make_automaton()
    return automaton


def _places(raw: bytes, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans in code points instead of bytes."""
    if raw.isascii():
        return spans
    starts = np.cumsum(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80)
    count = lambda k: int(starts[k - 1]) if k else 0
    return [(kind, count(a), count(b)) for kind, a, b in spans]


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind in the order of KINDS; in code points, end exclusive."""
    raw = text.encode()
    plain = raw.decode("latin-1")  # a character for each byte; the patterns hold ASCII only
    hits = sorted((end + 1 - size, kind) for end, (kind, size) in _automaton().iter(raw.lower().decode("latin-1")))
    spans, after = [], dict.fromkeys(KINDS, 0)
    for start, kind in hits:
        if start < after[kind]:
            continue
        if kind == "assign":
            found = ASSIGN.match(plain, start)
            good = found and len(found[2]) >= VALUE
        elif kind == "access":
            found = ACCESS.match(plain, start)
            good = found and found.end() - start >= ACCESS_LENGTH
        else:
            found = CHECKED_BODY.match(plain, start + 4) if plain[start : start + 4] in CHECKED[kind] else None
            good = found and checksum(found[0][:30]) == found[0][30:]
        if found:
            after[kind] = found.end()
        if good:
            spans.append((kind, start, found.end()))
    at = 0
    for k in (np.flatnonzero(_IS_HEX[np.frombuffer(raw, np.uint8)[HEX_RUN - 1 :: HEX_RUN]]) * HEX_RUN + HEX_RUN - 1).tolist():
        if k >= at:  # a run that long holds one of these places at least
            start = k + 1 - len(HEX.match(plain[max(at, k + 1 - HEX_RUN) : k + 1][::-1])[0])
            at = HEX.match(plain, k).end()
            if at - start >= HEX_RUN:
                spans.append(("hex", start, at))
    spans = _places(raw, spans) if spans else spans
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0])))


def scan_secrets(docs: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """All rows and columns, and spans: array of (kind, start, end)."""
    if spans_col in docs.columns:
        raise ValueError(f"there is a column {spans_col} already")
    position = docs.columns.index(text_col)
    kind = T.StructType().add("kind", "string").add("start", "long").add("end", "long")
    schema = T.StructType([*docs.schema.fields, T.StructField(spans_col, T.ArrayType(kind))])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in K.slices(whole, position)):
            found = [
                [{"kind": k, "start": a, "end": b} for k, a, b in find_secrets(text)] if text else []
                for text in batch.column(position).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, arrow)], names=[*batch.schema.names, spans_col])

    return docs.mapInArrow(run, schema)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each secret, and what overlaps it, put as its kind in brackets."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns, with the secrets of the texts masked."""
    position = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in K.slices(whole, position)):
            texts = [masked(x, find_secrets(x)) if x else x for x in batch.column(position).to_pylist()]
            columns = batch.columns
            columns[position] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
