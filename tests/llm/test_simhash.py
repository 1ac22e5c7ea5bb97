import hashlib

from tests.llm.conftest import messy_rows
from veilscan.llm import kernels as K
from veilscan.llm import simhash as S


def brute_force(rows):
    key = lambda x: (x[0] is None, -(x[0] or 0))
    rows = sorted([(a, b or "") for a, b in rows], key=key)
    mark = lambda text: S.fingerprint(K.word_hashes(text.encode()))
    out = []
    for k, (doc_id, text) in enumerate(rows):
        following, n = rows[(k + 1) % len(rows)][1], len(text) // 3
        new = text[: len(text) - n] + following[:n]
        out.append((doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), mark(text), mark(new), mark(following)))
    return out


def ours(df):
    return [
        (x.doc_id, x.n_chars, x.edited_sha256, bytes(x.fingerprint), bytes(x.edited_fingerprint), bytes(x.next_fingerprint))
        for x in S.compare_with_next(df).collect()
    ]


def test_documents(documents):
    rows = [tuple(x) for x in documents.select("doc_id", "text").collect()]
    want = brute_force(rows)
    assert sorted(ours(documents.repartition(7))) == sorted(want)
    near = [S.likeness(x[3], x[4]) for x in want]
    far = [S.likeness(x[3], x[5]) for x in want]
    assert sum(near) / len(near) > sum(far) / len(far) + 0.15


def test_messy(messy, spark):
    rows = [x[:2] for x in messy_rows()]
    distinct = list({x[0]: x for x in rows}.values())
    df = spark.createDataFrame(distinct, "doc_id long, text string").repartition(5)
    assert sorted(ours(df), key=repr) == sorted(brute_force(distinct), key=repr)
    assert len(ours(messy)) == len(rows)
    one = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    assert ours(one) == brute_force([(1, "a b c d")])


def test_empty(nothing):
    assert ours(nothing) == []
    assert S.add_fingerprints(nothing).collect() == []


def test_search_within_radius(documents, spark):
    marks = sorted({S.fingerprint(K.word_hashes(x.text.encode())) for x in documents.select("text").collect()})
    flips = [int.from_bytes(marks[k], "big") ^ sum(1 << (b * 7 % 128) for b in range(k)) for k in range(6)]
    marks += [x.to_bytes(16, "big") for x in flips]
    df = spark.createDataFrame([(bytearray(x),) for x in marks] + [(None,)], "fingerprint binary")
    gap = lambda x, y: (int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_count()
    marks = set(marks)
    want = {(x, y, gap(x, y)) for x in marks for y in marks if gap(x, y) <= 3}
    assert {(bytes(x["query"]), bytes(x.found), x.distance) for x in S.near_fingerprints(df, df, 3).collect()} == want
    assert len(want) > len(marks) + 4


def test_equal_texts_and_other_columns(messy):
    got = S.add_fingerprints(messy).collect()
    by_text = {}
    for x in got:
        by_text.setdefault(x.text, set()).add(bytes(x.fingerprint))
    assert all(len(x) == 1 for x in by_text.values())
    assert by_text[None] == by_text[""] == {bytes(16)}
