import random
import re

import pytest

from tests.llm.conftest import messy_rows
from veilscan.llm import secret_scan as S


def brute_force(text):
    """Base spans by searches of the whole text."""
    text, spans = text or "", []
    for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            spans.append(("assign", *m.span()))
    spans += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(spans, key=lambda x: (x[1], S.BASE.index(x[0])))


def base(text):
    return [x for x in S.find_secrets(text) if x[0] in S.BASE]


PARTS = ["password", "PASSWD", "secret", "Token", "api_key", "apikey", "=", ": ", "'", '"', " ", "AKIA", "ABCDEFGH1234", "abcdef0123456789" * 2, "deadbeef", "é", "ſecret", "toKen", "\n", "x" * 9, "tokentoken=", "--", "中"]


def test_random_texts():
    for seed in range(3000):
        r = random.Random(seed)
        text = "".join(r.choice(PARTS) for _ in range(r.randrange(1, 14)))
        assert base(text) == brute_force(text), text


def test_documents(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = [x.text for x in documents.select("text").collect()]
    assert [base(x) for x in texts] == [brute_force(x) for x in texts]
    assert any(base(x) for x in texts)


def test_checksums():
    body = "abcdefghij0123456789ABCDEFGHIJ"
    good = body + S.checksum(body)
    assert S.find_secrets(f"é ghp_{good}!") == [("github", 2, 42)]
    assert S.find_secrets(f"npm_{good}") == [("npm", 0, 40)]
    assert S.find_secrets(f"ghp_{body}000000") == []
    assert S.find_secrets(f"ghp_{good}a") == []


def test_messy(messy):
    got = S.scan_secrets(messy, spans_col="found").collect()
    assert sorted(repr([(s.kind, s.start, s.end) for s in x.found]) for x in got) == sorted(repr(S.find_secrets(x[1] or "")) for x in messy_rows())
    masked = {x.doc_id: x.text for x in S.mask_secrets(messy).collect()}
    assert masked[18] == "[ASSIGN]' token:abc [ACCESS] [HEX]" and masked[7] is None


def test_long_text():
    text = "0123456789abcdef" * 50_000 + " " + "token=" * 50_000
    assert base(text) == brute_force(text)


def test_empty_and_clash(nothing, messy):
    assert S.scan_secrets(nothing).count() == 0
    with pytest.raises(ValueError):
        S.scan_secrets(messy, spans_col="item")
