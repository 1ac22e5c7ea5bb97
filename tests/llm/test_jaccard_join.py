import random
import re

import numpy as np
import pytest

from tests.llm.conftest import edited, messy_rows, prose
from veilscan.llm import jaccard_join as J
from veilscan.llm import kernels as K

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    words = SPACE.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1)))


def brute_force(rows, n, percent):
    sets = [shingles(text, n) for _, text in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    out = []
    for k, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(k) and rows[j][0] is not None]
        out.append((doc_id, len(sets[k]), min(ids) if ids and sets[k] else doc_id))
    return sorted(out, key=repr)


def ours(df, n, percent):
    return sorted(map(tuple, J.similar_documents(df, n, percent).collect()), key=repr)


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_messy(messy, n, percent):
    assert ours(messy, n, percent) == brute_force([x[:2] for x in messy_rows()], n, percent)


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (2, 60)])
def test_documents(documents, n, percent):
    rows = [tuple(x) for x in documents.select("doc_id", "text").collect()]
    assert ours(documents, n, percent) == brute_force(rows, n, percent)


def test_large_group_of_near_copies(spark):
    base = prose(5, 150)
    rows = []
    for k in range(300):
        text = base
        for j in range(k % 5):
            text = edited(text, random.Random(k * 7 + j).randrange(150))
        rows.append((k, text + f" end{k}"))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert ours(df, 3, 90) == brute_force(rows, 3, 90)


def test_empty(nothing):
    assert ours(nothing, 3, 90) == []


@pytest.mark.parametrize("percent", [90, 80, 60])
def test_similar_sets_share_a_signature(percent):
    """With every token frequent, with none, and with some."""
    r = np.random.default_rng(percent)
    for n in [1, 2, 3, 5, 8, 10, 20, 64, 70, 127, 130, 500, 1100, 3000]:
        for _ in range(8):
            tokens = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
            cut = r.integers(0, n * (100 - percent) // 100 + 1) // 2
            other = np.unique(np.concatenate([tokens[cut:], r.integers(0, 2**63, cut, dtype=np.uint64)]))
            both = len(np.intersect1d(tokens, other))
            if 100 * both < percent * (len(tokens) + len(other) - both) or np.array_equal(tokens, other):
                continue
            for share in (0, 0.5, 0.95, 1):
                counts = np.where(r.random(J.SKETCH) < share, 1000, 1)
                x, y = (set(J.signatures(t, counts, 500, percent).tolist()) for t in (tokens, other))
                assert x & y


def test_word_hashes_of_blocks(monkeypatch):
    text = prose(4, 3000).encode()
    whole = K.word_hashes(text)
    monkeypatch.setattr(K, "BLOCK", 100)
    assert np.array_equal(K.word_hashes(text), whole)
    assert len(np.unique(whole)) == len(set(text.split()))
