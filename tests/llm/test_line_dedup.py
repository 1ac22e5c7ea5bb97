import pytest

from tests.llm.conftest import messy_rows, prose
from veilscan.llm import line_dedup as L


def pieces(line):
    return {line[k : k + 8] for k in range(len(line) - 7)} or {line}


def brute_force(rows, percent=80):
    """Texts after deduplication, for distinct (id, text) rows given in order."""
    lines = sorted({x for _, text in rows for x in (text or "").split("\n") if x.strip()})
    root = {x: x for x in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in lines:
        for b in lines:
            if a < b:
                p, q = pieces(a), pieces(b)
                if 100 * len(p & q) >= percent * len(p | q):
                    root[find(a)] = find(b)
    return find


def kept_lines(rows, find):
    """For each component, how many of its lines stay over all distinct documents."""
    out = {}
    for _, text in set(rows):
        for line in (text or "").split("\n"):
            if line.strip():
                out[find(line)] = out.get(find(line), 0) + 1
    return out


def check(df, rows):
    find = brute_force(rows)
    got = L.dedup_lines(df, dropped_col="n_dropped").select("doc_id", "text", "n_dropped").collect()
    assert len(got) == len(rows)
    kept = kept_lines([(x.doc_id, x.text) for x in got], find)
    assert set(kept.values()) <= {1}
    assert set(kept) == set(kept_lines(rows, find))
    before = {}
    for doc_id, text in rows:
        before.setdefault(doc_id, []).append(text)
    for x in got:
        assert any(
            (x.text is None) == (text is None)
            and len((text or "").split("\n")) - x.n_dropped == len((x.text or "").split("\n")) - (x.text == "" and x.n_dropped > 0)
            for text in before[x.doc_id]
        )


def test_messy(messy):
    check(messy, [x[:2] for x in messy_rows()])


def test_other_columns_pass(messy):
    got = L.dedup_lines(messy)
    assert got.columns == messy.columns
    drop = lambda rows: sorted([repr((x.doc_id, x.lang, x.source, x.n_chars, x.item, x["_gone"], x.place)) for x in rows])
    assert drop(got.collect()) == drop(messy.collect())


def test_first_occurrence_stays(spark):
    line = prose(1, 20)
    rows = [(3, line + "\nx y z 1 2 3"), (1, "start of one\n" + line + " more"), (2, line)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id: x.text for x in L.dedup_lines(df).collect()} == {1: rows[1][1], 2: "", 3: "x y z 1 2 3"}


def test_documents(documents):
    rows = [tuple(x) for x in documents.select("doc_id", "text").limit(60).collect()]
    check(documents.sparkSession.createDataFrame(rows, "doc_id long, text string"), rows)


def test_empty(nothing):
    assert L.dedup_lines(nothing).collect() == []


def test_clash(messy):
    with pytest.raises(ValueError):
        L.dedup_lines(messy, dropped_col="item")


def test_repeats_within_lines(spark):
    rows = [(1, "=" * 20 + "\n" + "ab" * 9), (2, "=" * 90 + "\n" + "ab" * 40), (3, "=" * 9 + "\nsomething else")]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)
