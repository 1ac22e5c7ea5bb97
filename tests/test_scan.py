import random

import pytest

from catalog.queries import PieceScorer, toy_model
from veilscan import Scanner, Settings, entity_rows, scan_table

TEXT = "schema doc_id int, text string".removeprefix("schema ")


def documents(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), TEXT)


def test_gates(spark):
    texts = ["mail a.b@x.org", "plain", "", " \n", "x" * 5000, None]
    scanner = Scanner.for_request(overrides={"max_file_size_mb": 0.004}, limit_texts=True)
    rows = {r.doc_id: r for r in scan_table(documents(spark, texts), "text", "doc_id", scanner).collect()}
    assert set(rows) == {0, 1, 2, 3, 4}
    assert [(rows[i].status, rows[i].pii_count, rows[i].chunks_processed) for i in range(5)] == [
        ("success", 1, 1), ("success", 0, 1), ("skipped", 0, 0), ("skipped", 0, 0), ("skipped", 0, 0),
    ]
    assert rows[2].error == rows[3].error == "Empty file"
    assert rows[4].error == "File too large (0.0MB > 0.0MB)" and rows[4].file_size_bytes == 5000
    assert rows[0].error is None


def test_offsets_are_of_the_document(spark):
    rng = random.Random(1)
    texts = []
    for _ in range(60):
        words = [rng.choice(["é", "some", "word\n", "a.b@x.org", "10.1.2.3", "😀"]) for _ in range(200)]
        texts.append(" ".join(words))
    scanner = Scanner.for_request(overrides={"max_chunk_size": 64})
    found = entity_rows(scan_table(documents(spark, texts), "text", "doc_id", scanner), ["doc_id"])
    rows = found.collect()
    assert len(rows) == sum(t.count("a.b@x.org") + t.count("10.1.2.3") for t in texts)
    for row in rows:
        assert texts[row.doc_id].encode()[row.start : row.end].decode() == row.text


def test_labels_restrict_the_scan(spark):
    df = documents(spark, ["a.b@x.org 10.0.0.1"])

    def labels(*wanted):
        scanner = Scanner.for_request(labels=wanted)
        return [e.label for e in scan_table(df, "text", "doc_id", scanner).first().entities]

    assert labels("EMAIL") == ["email"]
    assert labels("email", "ip address") == ["email", "ip address"]
    assert Scanner.for_request(labels=["speaker"]).unsupported_labels == ["speaker"]


def test_filters(spark):
    df = documents(spark, ["my.email@x.org 555-1234"])

    def count(**options):
        return scan_table(df, "text", "doc_id", Scanner.for_request(**options)).first().pii_count

    assert count() == 0
    assert count(overrides={"filter_false_positives": False}) == 2
    assert count(filters=False) == 2
    assert count(filters=False, overrides={"threshold": 0.46}) == 1


def test_higher_threshold_covers_less(spark):
    df = documents(spark, ["abc defg hij\nop uvw xyz ab c"] * 3)

    def covered(threshold):
        scanner = Scanner(
            labels=(), settings=Settings(threshold=threshold), scorer=PieceScorer(), filters=False
        )
        rows = entity_rows(scan_table(df, "text", "doc_id", scanner), ["doc_id"]).collect()
        return {(r.doc_id, i) for r in rows for i in range(r.start, r.end)}

    low, middle, high = covered(0.1), covered(0.5), covered(0.8)
    assert high < middle < low


def test_several_id_columns(spark):
    df = spark.createDataFrame([(1, "a", "x@y.org"), (1, "b", "none")], "c int, d string, t string")
    rows = scan_table(df, "t", ["c", "d"]).collect()
    assert {(r.c, r.d, r.pii_count) for r in rows} == {(1, "a", 1), (1, "b", 0)}


def test_names_of_id_columns(spark):
    with pytest.raises(ValueError, match="text"):
        scan_table(documents(spark, ["a"]).withColumnRenamed("doc_id", "error"), "text", ["error", "text"])


@pytest.mark.parametrize("spread", [None, 8])
def test_model_scorer_keeps_every_document(spark, spread):
    texts = ["some words here " * 30, "", "x", "y" * 5000, "a b"]
    scanner = Scanner(
        labels=(),
        settings=Settings(max_chunk_size=100, max_file_size_mb=0.004),
        scorer=toy_model(),
        filters=False,
        spread_chunks=spread,
        limit_texts=True,
    )
    rows = {r.doc_id: r for r in scan_table(documents(spark, texts), "text", "doc_id", scanner).collect()}
    assert [rows[i].status for i in range(5)] == ["success", "skipped", "success", "skipped", "success"]
    assert [rows[i].chunks_processed for i in range(5)] == [5, 0, 1, 0, 1]
    starts = [e.start for e in rows[0].entities]
    assert starts == sorted(starts) and rows[0].pii_count == len(starts) > 5


def test_model_scorer_keeps_copies(spark):
    rows = [(1, "some words")] * 500 + [(1, "other words here")] * 3 + [(1, "")] * 2 + [(2, "some words")]
    df = spark.createDataFrame(rows, "id int, t string")
    scanner = Scanner(labels=(), settings=Settings(max_chunk_size=8), scorer=toy_model(), filters=False)
    results = scan_table(df, "t", "id", scanner)
    counts = {tuple(r) for r in results.groupBy("id", "file_size_bytes", "status").count().collect()}
    assert counts == {
        (1, 10, "success", 500), (1, 16, "success", 3), (1, 0, "skipped", 2), (2, 10, "success", 1),
    }
    found = {(r.id, r.file_size_bytes, str(r.entities), r.chunks_processed) for r in results.collect()}
    assert len(found) == 4 and {f[2] for f in found if f[1] == 10} == {
        f[2] for f in found if f[:2] == (2, 10)
    }


def test_scan_of_a_large_input_does_not_shuffle(spark):
    df = documents(spark, ["a"])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1b")
    try:
        results = scan_table(df, "text", "doc_id")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    plan = results.filter("pii_count > 0")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    # The search of the text is in the plan once for each form of its pattern, not again per filter.
    assert plan.count("regexp_extract_all") == 2


def test_long_texts_of_a_table_are_scanned(spark):
    text = "x " * 4000 + "a.b@x.org"
    scanner = Scanner.for_request(overrides={"max_file_size_mb": 0.004})
    row = scan_table(documents(spark, [text]), "text", "doc_id", scanner).first()
    assert (row.status, row.pii_count) == ("success", 1)


@pytest.mark.parametrize("run", ["1.", "1", "a", "@", "-", " ", "a.", "a@b.co "])
def test_long_runs_neither_overflow_nor_stall(spark, run):
    scanner = Scanner.for_request(overrides={"max_chunk_size": 2_000_000_000})
    text = run * (20_000 if run == "a" else 2_000 if "@b" in run else 300_000) + " a.b@x.org"
    row = scan_table(documents(spark, [text]), "text", "doc_id", scanner).first()
    assert row.status == "success" and row.entities[-1].text == "a.b@x.org"
