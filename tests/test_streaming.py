import pytest
from pyspark.errors import StreamingQueryException

from catalog.queries import toy_model
from veilscan import Scanner, scan_directory, scan_stream
from veilscan.plans.scan import scan_table
from veilscan.sources.files import gate_arrived
from veilscan.streaming.arrivals import arriving_files, list_arrivals, run_available


def test_landing_directory(spark, tmp_path):
    landing, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    scanner = Scanner.for_request(overrides={"max_file_size_mb": 0.001})
    (tmp_path / "in").mkdir()

    def land(name, text):
        (tmp_path / "in" / name).write_text(text)

    def run():
        scan_stream(spark, landing, out, checkpoint, scanner).awaitTermination()
        return spark.read.parquet(out)

    land("a.txt", "a.b@x.org")
    land("skip.bin", "a.b@x.org")
    land("large.txt", "x" * 3000)
    assert run().count() == 2
    land("b.log", "10.0.0.1 and é")
    land("empty.md", "")
    land(".hidden.txt", "c.d@x.org")
    land("_kept.md", "")
    (tmp_path / "in" / "deep").mkdir()
    land("deep/_n.json", "10.0.0.2")
    (tmp_path / "in" / "broken.txt").write_bytes(b"\xff\xfe\x00\xd8")
    (tmp_path / "in" / "link.txt").symlink_to(tmp_path / "in" / "deep")
    (tmp_path / "in" / "gone.txt").symlink_to(tmp_path / "in" / "nothing")
    found = run()
    # Every file once, and each as in a batch.
    expected = scan_directory(spark, landing, scanner=scanner)
    columns = expected.columns
    assert sorted(found.select(columns).collect(), key=repr) == sorted(expected.collect(), key=repr)
    assert found.count() == 10 and {x.status for x in found.collect()} == {"success", "skipped", "error"}
    assert run().count() == 10  # nothing new


def test_restart_in_the_middle_of_a_batch(spark, tmp_path):
    landing, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    (tmp_path / "in").mkdir()
    for k in range(30):
        (tmp_path / "in" / f"{k}.txt").write_text(f"u{k}@x.org")

    def run(fail):
        def write(batch, batch_id):
            half = batch.filter("file like '%1%'") if fail else batch
            half.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
            if fail:
                raise RuntimeError("lost")

        files = arriving_files(spark, landing, checkpoint, 1000)
        query = gate_arrived(files, Scanner().settings).writeStream.foreachBatch(write)
        return run_available(query.option("checkpointLocation", checkpoint))

    with pytest.raises(StreamingQueryException):
        run(True).awaitTermination()
    (tmp_path / "in" / "late.txt").write_text("late@x.org")
    run(False).awaitTermination()
    names = [x.file.rpartition("/")[2] for x in spark.read.parquet(out).collect()]
    assert sorted(names) == sorted([*[f"{k}.txt" for k in range(30)], "late.txt"])


def test_listing_that_was_broken_off_is_made_anew(spark, tmp_path):
    landing, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("a")
    assert list_arrivals(spark, landing, checkpoint) == 1
    (tmp_path / "in" / "b.txt").write_text("b")
    assert list_arrivals(spark, landing, checkpoint) == 2
    (tmp_path / "checkpoint-arrivals" / "1" / "_whole").unlink()
    (tmp_path / "in" / "c.txt").write_text("c")
    assert list_arrivals(spark, landing, checkpoint) == 2
    names = {x.path.rpartition("/")[2] for x in spark.read.parquet(f"{checkpoint}-arrivals/1").collect()}
    assert names == {"b.txt", "c.txt"}


def test_running_stream_lists_again(spark, tmp_path):
    landing, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("a.b@x.org")
    query = scan_stream(spark, landing, out, checkpoint, trigger={"processingTime": "1 second"}, list_seconds=1.0)
    try:
        for names in (["a.txt"], ["a.txt", "b.txt"]):
            for _ in range(60):
                query.awaitTermination(1)
                found = spark.read.schema("file string").parquet(out).collect() if (tmp_path / "out" / "_spark_metadata").exists() else []
                if len(found) >= len(names):
                    break
            assert sorted(x.file.rpartition("/")[2] for x in found) == names
            (tmp_path / "in" / "b.txt").write_text("b.c@x.org")
    finally:
        query.stop()


def test_table_stream_is_lazy(spark, tmp_path):
    spark.createDataFrame([(1, "x@y.org")], "id int, t string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, t string").parquet(str(tmp_path / "in"))
    assert scan_table(stream, "t", "id").isStreaming


@pytest.mark.parametrize("spread", [None, 3])
def test_model_stream(spark, tmp_path, spread):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("some words")
    scanner = Scanner(labels=(), scorer=toy_model(), filters=False, spread_chunks=spread)
    landing, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    scan_stream(spark, landing, out, checkpoint, scanner).awaitTermination()
    (tmp_path / "in" / "b.txt").write_text("more words")
    scan_stream(spark, landing, out, checkpoint, scanner).awaitTermination()
    expected = scan_directory(spark, landing, scanner=scanner)
    found = spark.read.parquet(out).select(expected.columns)
    assert sorted(found.collect(), key=repr) == sorted(expected.collect(), key=repr)
    stream = spark.readStream.schema("id int, t string").parquet(landing)
    if spread is None:
        assert scan_table(stream, "t", "id", scanner).isStreaming
    else:
        with pytest.raises(ValueError, match="scan_stream"):
            scan_table(stream, "t", "id", scanner)
