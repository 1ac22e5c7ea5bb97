import json

import pytest
from pyspark.sql import functions as F

from veilscan import report, report_rows, summarise, write_response
from veilscan.functions.columns import fixed
from veilscan.plans.report import (
    confidence_band,
    count_labels,
    count_statuses,
    entity_rows,
    group_by_label,
)
from veilscan.schemas import ENTITY
from veilscan.sources.sinks import result_json

SCHEMA = (
    f"file string, status string, entities array<{ENTITY}>, pii_count bigint, "
    "file_size_bytes bigint, chunks_processed int, error string"
)


def entity(i, label="email", score=0.9):
    return (f"t{i}", label, score, i, i + 1)


@pytest.fixture
def results(spark):
    rows = [
        ("a", "success", [entity(0), entity(1, "Zip"), entity(2, score=0.6)], 3, 10, 1, None),
        ("b", "success", [], 0, 10, 1, None),
        ("c", "skipped", [], 0, 0, 0, "Empty file"),
        ("d", "error", [], 0, None, 0, "broken"),
        (None, "error", [], 0, None, 0, "unknown"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_summary(results, spark):
    assert summarise(results.filter("file is not null")).first().asDict() == {
        "total_files": 4, "files_with_pii": 1, "total_pii": 3, "errors": 1,
    }
    empty = summarise(spark.createDataFrame([], SCHEMA)).first()
    assert tuple(empty) == (0, 0, 0, 0)


def test_counts(results):
    assert {tuple(r) for r in count_statuses(results).collect()} == {
        ("success", 2), ("skipped", 1), ("error", 2),
    }
    assert {tuple(r) for r in count_labels(results).collect()} == {("email", 2), ("Zip", 1)}
    assert [(r.ord, r.text) for r in entity_rows(results, ["file"]).collect()] == [
        (0, "t0"), (1, "t1"), (2, "t2"),
    ]


def test_visible(results):
    shown = {r.file: r for r in report(results).collect()}
    assert set(shown) == {"a", "d", None}
    assert shown["a"].headline == "a (3 entities)"
    assert shown["d"].message == "broken" and shown["d"].headline == "d"
    assert shown[None].headline == "<unknown file>"
    everything = {r.file: r for r in report(results, show_all=True).collect()}
    assert set(everything) == {"a", "b", "c", "d", None}
    assert everything["b"].headline == "b (no PII detected)"


def test_groups_by_label_in_byte_order(results):
    rows = report_rows(report(results)).collect()
    assert [(r.label, r["count"], [t.text for t in r.top], r.more) for r in rows] == [
        ("Zip", 1, ["t1"], 0), ("email", 2, ["t0", "t2"], 0),
    ]


def test_first_ten_in_document_order(evaluate):
    entities = [entity(i, score=i / 100) for i in range(12)]
    (groups,) = evaluate(group_by_label(F.col("e")), [(entities,)], f"e array<{ENTITY}>")
    (group,) = groups
    assert ([t.text for t in group.top], group.more) == ([f"t{i}" for i in range(10)], 2)


def test_band_and_rounding(evaluate):
    scores = [(0.71,), (0.7,), (0.5,), (0.49,)]
    assert evaluate(confidence_band(F.col("s")), scores, "s float") == ["high", "medium", "low", "low"]
    ties = [(0.125,), (0.375,), (0.95,), (1.0,), (0.005,)]
    # 0.005 as a 32-bit float is a little less than that.
    assert evaluate(fixed(F.col("s"), 2), ties, "s float") == ["0.12", "0.38", "0.95", "1.00", "0.00"]


def test_json_keeps_nulls(results):
    rows = results.orderBy("file").select(result_json("file", "error", "file_size_bytes", "entities"))
    first = json.loads(rows.filter("file = 'd'").first()[0])
    assert first == {"file": "d", "error": "broken", "file_size_bytes": None, "entities": []}


@pytest.mark.parametrize("format", ["json", "parquet"])
def test_write_response(spark, results, tmp_path, format):
    write_response(results, str(tmp_path / "out"), format)
    stored = spark.read.schema(SCHEMA).format(format).load(str(tmp_path / "out/results"))
    assert sorted(stored.collect(), key=repr) == sorted(results.collect(), key=repr)
    summary = spark.read.format(format).load(str(tmp_path / "out/summary")).first()
    assert (summary.total_files, summary.total_pii, summary.errors) == (5, 3, 2)
    if format == "json":
        lines = "".join(part.read_text() for part in (tmp_path / "out/results").glob("*.json"))
        assert lines.count("\n") == 5
        assert '"error":null' in lines
