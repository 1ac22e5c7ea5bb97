"""BPE and packing against the tokenizers library."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.conftest import messy_rows
from veilscan.llm import bpe, packing

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ALPHABET = ["a", "b", "the", "The", " ", "  ", "\n", "\t", "'s", "'S", "'re", "’", "é", "É", "é", "ß", "İ", "Σ", "ς", "中", "文", "1", "23", "½", "٣", "²", "Ⅷ", ".", "!!", "<|endoftext|>", "<|startoftext|>", "<|", "|>", " ", " ", " ", "\x1c", "\x85", "​", "😀", "_", "ing", "qzxj", "ﬁ", "ǅ", "각", "가", "K", "Å", "🏳️‍🌈"]


def texts():
    out = [x[1] or "" for x in messy_rows()]
    for seed in range(1500):
        r = random.Random(seed)
        out.append("".join(r.choice(ALPHABET) for _ in range(r.randrange(1, 15))))
    return out


def expected(path, values):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch(values, add_special_tokens=False)]


def test_byte_ids():
    values, vocabulary = texts(), bpe.Vocabulary(BYTES)
    for words in ([], [b"the", b" the", b"ing", " é".encode(), b"a", b"aa", b"aaaa"]):
        encoder = bpe.Encoder(vocabulary, bpe.Lexicon(np.frombuffer(bpe.build_lexicon(words, vocabulary), np.int32)))
        assert [x.tolist() for x in encoder(values)] == expected(BYTES, values)


def test_lexicon_shares_suffixes_and_finds_all():
    vocabulary = bpe.Vocabulary(BYTES)
    words = sorted({f"{a}{b}ing".encode() for a in "abcdefgh" for b in "klmnop"} | {b"a", b"ab"})
    lexicon = bpe.Lexicon(np.frombuffer(bpe.build_lexicon(words, vocabulary), np.int32))
    assert len(lexicon.finals) < 12
    assert lexicon.find(words).tolist() == list(range(len(words)))
    assert lexicon.find([b"", b"x", b"abing"[:3], b"akin", b"akings"]).tolist() == [-1] * 5


def test_merges_never_make_a_lower_rank():
    vocabulary = bpe.Vocabulary(BYTES)
    rank_of = dict(zip(vocabulary.made.tolist(), vocabulary.ranks.tolist(), strict=True))
    for pair, rank in zip(vocabulary.pairs.tolist(), vocabulary.ranks.tolist(), strict=True):
        assert max(rank_of.get(pair >> 32, -1), rank_of.get(pair & 0xFFFFFFFF, -1)) < rank


def test_encode_and_decode(messy):
    rows = bpe.decode(bpe.encode(messy, BYTES, 50), BYTES).collect()
    library = Tokenizer.from_file(BYTES)
    for x in rows:
        ids = library.encode(x.text or "", add_special_tokens=False).ids
        assert np.frombuffer(x.ids, "<u4").tolist() == ids
        assert x.decoded == library.decode(ids, skip_special_tokens=False)
    assert len(rows) == len(messy_rows())


def test_long_words_stay_out_of_the_lexicon(spark):
    long = ["a" * 300_000, "é" * 40, "x" * 65, "\u3000" * 30, "." * 5000]
    df = spark.createDataFrame([(k, x) for k, x in enumerate([*long, "x" * 64, "é" * 32, "the cat"])], "doc_id long, text string").repartition(3)
    assert set(bpe.frequent_words(df, BYTES)) == {b"x" * 64, "é".encode() * 32, b"the", b" cat"}
    rows = bpe.encode(df, BYTES).collect()
    assert [np.frombuffer(x.ids, "<u4").tolist() for x in rows] == expected(BYTES, [x.text for x in rows])


def test_long_words_are_merged_exactly():
    vocabulary, r = bpe.Vocabulary(BYTES), random.Random(2)
    words = ["".join(r.choices(letters, k=n)) for letters in ("abcdefghijklmnopqrstuvwxyz", "aab", "éüx中", "a") for n in (1001, 1500, 30_000)]
    lengths, ids = vocabulary.merge(["the".encode(), *[w.encode() for w in words], b"", b"ing"])
    parts = np.split(ids, np.cumsum(lengths)[:-1])
    assert [x.tolist() for x in parts] == expected(BYTES, ["the", *words, "", "ing"])


def test_frequent_words_are_about_as_many_as_asked_for(spark):
    texts = [" ".join(f"w{'abcdefgh'[k // 8 % 8]}{'ijklmnop'[k % 8]}" for k in range(64) for _ in range(1 + k // 16)) for _ in range(3)]
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    assert len(bpe.frequent_words(df, BYTES, 1000)) == 64
    few = bpe.frequent_words(df, BYTES, 40)
    assert 30 <= len(few) <= 50 and {f" wh{x}".encode() for x in "ijklmnop"} <= set(few)


def test_decode_of_broken_bytes(spark):
    library, ids = Tokenizer.from_file(BYTES), [[163, 99, 50256, 120], [94, 95, 10, 11], list(range(127, 200))]
    rows = spark.createDataFrame([(bytearray(np.array(x, "<u4").tobytes()),) for x in ids], "ids binary")
    assert [x.decoded for x in bpe.decode(rows, BYTES).collect()] == [library.decode(x, skip_special_tokens=False) for x in ids]


@pytest.fixture(scope="module")
def word_tokenizer():
    return packing.WordTokenizer(WORDS, packing.library_characters(WORDS))


def test_word_ids_of_every_code_point(word_tokenizer):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    values = ["".join(f"a{x}b {x} {x}1 e{x}\u0301 " for x in points[k : k + 40]) for k in range(0, len(points), 40)]
    for at in range(0, len(values), 2000):
        own = values[at : at + 2000]
        assert [x.tolist() for x in word_tokenizer(own)] == expected(WORDS, own)


def test_word_ids(word_tokenizer):
    values = texts()
    got = [x.tolist() for x in word_tokenizer(values)]
    wrong = [(v, g, e) for v, g, e in zip(values, got, expected(WORDS, values), strict=True) if g != e]
    assert not wrong, wrong[:3]


@pytest.mark.parametrize("length", [2048, 64])
def test_packing(messy, length):
    rows = packing.pack(messy, WORDS, 1, length).collect()
    want = sorted([*e, 1] for e in expected(WORDS, [x[1] or "" for x in messy_rows()]))
    sequences, by_doc = {}, {}
    for x in rows:
        ids = np.frombuffer(x.ids, "<u4").tolist()
        assert len(ids) == x.length > 0
        sequences.setdefault(x.sequence_id, []).append((x.offset, x.length))
        by_doc.setdefault(x.doc_id, []).append((x.start, x.doc_tokens, ids))
    for own in sequences.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False))
        total = own[-1][0] + own[-1][1]
        assert total == length or total & (total - 1) == 0 and total < length
    assert sum(x.length for x in rows) == sum(map(len, want))
    by_id = {}
    for (doc_id, *_), e in zip(messy_rows(), expected(WORDS, [x[1] or "" for x in messy_rows()]), strict=True):
        by_id.setdefault(doc_id, []).append([*e, 1])
    for doc_id, pieces in by_doc.items():
        if len(by_id[doc_id]) == 1:
            pieces.sort()
            assert [i for _, _, ids in pieces for i in ids] == by_id[doc_id][0]
            assert {n for _, n, _ in pieces} == {len(by_id[doc_id][0])}
            assert [s for s, _, _ in pieces] == np.cumsum([0, *[len(i) for _, _, i in pieces]])[:-1].tolist()


def test_packing_of_nothing(nothing):
    assert packing.pack(nothing, WORDS).collect() == []
    assert bpe.encode(nothing, BYTES).collect() == []


def test_hilbert_curve_visits_neighbours():
    cells = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    place = packing.hilbert_index(cells, 3)
    assert sorted(place) == list(range(512))
    along = cells[np.argsort(place)]
    assert (np.abs(np.diff(along, axis=0)).sum(1) == 1).all()
