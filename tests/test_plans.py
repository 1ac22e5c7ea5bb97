"""What the physical plans must look like to hold at any size."""


from catalog import queries
from veilscan import Scanner, Settings, scan_table
from veilscan.sources.files import gate_files, list_directory

SF_DIR = "/root/testdata/sf0.001"


def plan(frame, mode="formatted"):
    explain = frame._jvm.PythonSQLUtils.explainString if hasattr(frame, "_jvm") else None
    if explain is None:
        explain = frame.sparkSession._jvm.PythonSQLUtils.explainString
    return explain(frame._jdf.queryExecution(), mode)


def test_large_files_are_not_read(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    gated = gate_files(list_directory(spark, str(tmp_path)), Settings(max_file_size_mb=1.0))
    text = plan(gated)
    scans = [part for part in text.split("\n\n") if "ReadSchema" in part]
    assert len(scans) == 2
    large = next(part for part in scans if "GreaterThan(length" in part)
    small = next(part for part in scans if "LessThanOrEqual(length" in part)
    assert "content" not in large.split("ReadSchema")[1]
    assert "content" in small.split("ReadSchema")[1]


def test_report_stays_in_the_row(spark):
    text = plan(queries.q_top10_per_label(spark, SF_DIR))
    assert "Window" not in text and "Sort" not in text
    assert "hashpartitioning" not in text


def test_only_needed_columns_are_read(spark):
    text = plan(queries.q_scan_documents(spark, SF_DIR))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_counts_are_combined_before_the_shuffle(spark):
    for query in (queries.q_scan_summary, queries.q_by_label, queries.q_status_counts):
        text = plan(query(spark, SF_DIR))
        assert "partial_count" in text


def test_counting_statuses_scans_nothing(spark):
    text = plan(queries.q_status_counts(spark, SF_DIR))
    assert "regexp" not in text.lower() and "chunk" not in text


def test_model_scan_stays_in_the_row(spark):
    text = plan(queries.q_model_scan(spark, SF_DIR))
    assert "Aggregate" not in text and "ArrowEvalPython" in text
    # Documents are dealt out once, before the scan.
    assert sum("Exchange" in line and line.lstrip(" :+-").startswith("Exchange") for line in text.split("\n\n")[0].splitlines()) == 1


def test_spread_chunks_are_collected_by_document(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    scanner = Scanner(labels=(), scorer=queries.toy_model(), spread_chunks=4)
    assert "partial_collect_set" in plan(scan_table(documents, "text", "doc_id", scanner))
