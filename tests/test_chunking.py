import random

import pytest
from pyspark.sql import functions as F

from veilscan.operators.chunking import chunk_starts, chunk_text

GOLDEN = [
    ("", 10, [(0, "")]),
    ("hello", 10, [(0, "hello")]),
    ("aaaa bbbb cccc", 10, [(0, "aaaa bbbb "), (10, "cccc")]),
    ("ab\ncd efghijk", 10, [(0, "ab\n"), (3, "cd efghijk")]),
    ("a b c\nd e f g h i j", 10, [(0, "a b c\n"), (6, "d e f g h "), (16, "i j")]),
    ("\nabc defghij k", 10, [(0, "\nabc defgh"), (10, "ij k")]),
    (" abcdefghijkl", 10, [(0, " abcdefghi"), (10, "jkl")]),
    ("ééééé", 5, [(0, "éé"), (4, "éé"), (8, "é")]),
]


def cut(text, size):
    """Brute force over the bytes."""
    data, chunks, start = text.encode(), [], 0
    if len(data) <= size:
        return [(0, text)]
    while start < len(data):
        end = min(start + size, len(data))
        if end < len(data):
            window = data[start:end]
            newline, space = window.rfind(b"\n"), window.rfind(b" ")
            if newline > 0 or (newline < 0 and space > 0):
                end = start + (newline if newline > 0 else space) + 1
            else:
                while data[end] & 0xC0 == 0x80:
                    end -= 1
        chunks.append((start, data[start:end].decode()))
        start = end
    return chunks


def chunked(evaluate, texts, size):
    found = evaluate(chunk_text(F.col("t"), size), [(t,) for t in texts], "t string")
    for chunks in found:
        assert [c.chunk_idx for c in chunks] == list(range(len(chunks)))
    return [[(c.offset, c.text) for c in chunks] for chunks in found]


@pytest.mark.parametrize("text, size, expected", GOLDEN)
def test_golden(evaluate, text, size, expected):
    assert chunked(evaluate, [text], size) == [expected]


@pytest.mark.parametrize("size", [4, 5, 7, 16, 100])
def test_random_texts(evaluate, size):
    rng = random.Random(size)
    texts = [
        "".join(rng.choices("ab \né€😀", [4, 4, 2, 1, 2, 1, 1], k=rng.randrange(0, 400)))
        for _ in range(150)
    ]
    found = chunked(evaluate, texts, size)
    assert found == [cut(text, size) for text in texts]
    assert ["".join(t for _, t in chunks) for chunks in found] == texts


@pytest.mark.parametrize("unit", ["a\n" + "b" * 20, "a\nb " + "c" * 30, "x", "é", " ", "\n"])
def test_short_chunks_in_a_row(evaluate, unit):
    text = unit * 500
    assert chunked(evaluate, [text], 16) == [cut(text, 16)]


def test_large_document(evaluate):
    text = "some words here é\nand more " * 40_000
    (starts,) = evaluate(chunk_starts(F.col("t"), 100), [(text,)], "t string")
    assert starts == [start for start, _ in cut(text, 100)]


def test_null_text(evaluate):
    assert evaluate(F.size(chunk_text(F.col("t"), 10)), [(None,)], "t string") == [1]
