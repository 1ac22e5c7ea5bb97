"""Encoding by prefixes against the library of the rank files."""

import random

import public_tokenizers
import pytest
import tiktoken

from tests.llm.conftest import messy_rows
from veilscan.llm import prefix_bpe as B

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ALPHABET = ["a", "b", "the", "The", " ", "  ", "\n", "\t", "'s", "'S", "'re", "'", "r", "é", "É", "ß", "İ", "中", "1", "23", "½", "٣", ".", "!!", "<|endoftext|>", "\x1c", "\x85", "​", "😀", "_", "ing", "qzxj", "aaaa", "각", "՘", "Ꟛ", "　", "ого"]


@pytest.fixture(scope="module")
def ranks():
    return B.Ranks.of_file(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.rank, special_tokens={})


@pytest.fixture(scope="module")
def encoder(ranks):
    return B.Encoder(ranks, B.Splitter(public_tokenizers.PATTERN, B.library_classes()))


def merged(ranks, data):
    """Ids by merging, one pair of least rank at a time, from the left."""
    parts = [bytes([x]) for x in data]
    while True:
        found = [(ranks.rank[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks.rank]
        if not found:
            return [ranks.rank[x] for x in parts]
        k = min(found)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def test_every_code_point(encoder, library):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["a" + "b1 ".join(points[k : k + 400]) + "a  b" for k in range(0, len(points), 400)]
    for at in range(0, len(texts), 50):
        own = texts[at : at + 50]
        assert [x.tolist() for x in encoder(own)] == [library.encode_ordinary(x) for x in own]


def test_every_token(ranks):
    for token in ranks.tokens[::7]:
        assert B.Piece(ranks, token).ids() == [ranks.rank[token]] == merged(ranks, token)


def test_random_texts(encoder, library):
    texts = ["".join(random.Random(k).choices(ALPHABET, k=1 + k % 30)) for k in range(3000)]
    assert [x.tolist() for x in encoder(texts)] == [library.encode_ordinary(x) for x in texts]


def test_prefixes_have_one_last_token(ranks):
    r = random.Random(5)
    for _ in range(200):
        data = "".join(r.choices(ALPHABET, k=6)).encode()
        piece = B.Piece(ranks, data)
        for k in range(1, len(data) + 1):
            assert piece.last[k - 1] == merged(ranks, data[:k])[-1]


def test_small_vocabulary_with_a_token_that_no_merges_make():
    words = [b"ab", b"bc", b"abc", b"xbc", b"aa", b"aaa", b"bca"]
    ranks = B.Ranks([bytes([k]) for k in range(256)] + words)
    assert b"bca" in ranks.reachable and b"abc" in ranks.reachable and b"xbc" in ranks.reachable
    hidden = B.Ranks([bytes([k]) for k in range(256)] + [b"ab", b"cd", b"abcd", b"bc", b"xbcd"])
    assert b"xbcd" not in hidden.reachable
    for own in (ranks, hidden):
        library = tiktoken.Encoding("own", pat_str=r"\w+", mergeable_ranks=own.rank, special_tokens={})
        encoder = B.Encoder(own, lambda text: [text] if text else [])
        r = random.Random(1)
        for _ in range(2000):
            text = "".join(r.choices("abcdx", k=r.randrange(1, 12)))
            assert encoder([text])[0].tolist() == library.encode_ordinary(text), text


def test_edits(encoder, library):
    for seed in range(1200):
        r = random.Random(seed)
        text = "".join(r.choices(ALPHABET, k=r.randrange(0, 25)))
        if seed % 3 == 0:
            text += " " + "".join(r.choices("abcdefgtheing", k=r.randrange(50, 400))) + " x"
        kept = encoder.editable([text])[0]
        for _ in range(4):
            start = r.randrange(0, len(text) + 1)
            stop = min(len(text), start + r.randrange(0, 4))
            if r.random() < 0.2:
                start = stop = len(text)
            new = "".join(r.choices(ALPHABET, k=r.randrange(0, 3)))
            text = text[:start] + new + text[stop:]
            kept.replace(start, stop, new)
            assert (kept.text, kept.ids.tolist()) == (text, library.encode_ordinary(text))


def test_edit_of_a_long_piece_is_local(ranks, encoder, library):
    text = "".join(random.Random(3).choices("abcdefghijklmnopqrstuvwxyz", k=200_000))
    piece = B.Piece(ranks, text.encode())
    assert piece.ids() == library.encode_ordinary(text)
    piece.encoded = 0
    piece.replace(100_000, 100_003, b"the")
    piece.append(b"ing")
    text = text[:100_000] + "the" + text[100_003:] + "ing"
    assert piece.ids() == library.encode_ordinary(text) and piece.encoded < 200
    kept = encoder.editable([text])[0]
    kept.replace(5, 5, "q")  # makes the piece one that edits can start from
    kept.encoded = 0
    kept.replace(50_000, 50_000, "zz")
    assert kept.encoded < 200


def test_encode_edit_and_decode(messy, library):
    rows = B.decode(B.encode(messy, PATH), PATH).collect()
    assert len(rows) == len(messy_rows())
    for x in rows:
        assert x.ids == library.encode_ordinary(x.text or "") and bytes(x.decoded).decode() == (x.text or "")
    part = lambda start, stop, text: f"named_struct('start', {start}, 'stop', {stop}, 'text', '{text}')"
    parts = part("1L", "3L", " ok"), part("cast(null as bigint)", "1L", "x"), "null", part("99999999L", "99999999L", ".")
    edits = messy.selectExpr("*", f"array({', '.join(parts)}) as edits")
    for x in B.encode_edited(edits, PATH, "edits").collect():
        text = x.text or ""
        assert x.ids == library.encode_ordinary(text)
        assert x.edited_ids == library.encode_ordinary(text[:1] + " ok" + text[3:] + ".")
    assert all(x.edited_ids == x.ids for x in B.encode_edited(messy.selectExpr("*", "cast(null as array<struct<start:long,stop:long,text:string>>) edits"), PATH, "edits").collect())


def test_empty_and_clash(nothing, messy):
    assert B.encode(nothing, PATH).collect() == []
    with pytest.raises(ValueError):
        B.encode(messy, PATH, ids_col="Item")


def test_query(spark, library):
    from veilscan.llm.queries import op13_prefix_bpe

    texts = {x.doc_id: x.text for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    import hashlib

    digest = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    rows = op13_prefix_bpe(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    for x in rows:
        text = texts[x.doc_id] or ""
        ids, edited = library.encode_ordinary(text), library.encode_ordinary(text[: len(text) // 2] + " ok" + text[len(text) // 2 :] + ".")
        assert (x.n_tokens, x.ids_sha256) == (len(ids), digest(ids)) and (x.edited_n_tokens, x.edited_ids_sha256) == (len(edited), digest(edited))
        assert x.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert x.encoded_bytes < 200
