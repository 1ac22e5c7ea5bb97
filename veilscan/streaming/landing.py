"""Scanning of documents as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from veilscan import schemas
from veilscan.operators.gates import text_glob
from veilscan.operators.model_scorer import ModelScorer
from veilscan.plans.scan import Scanner
from veilscan.sources.files import gate_arrived
from veilscan.streaming.arrivals import arriving_files, keep_listing, run_available


def landing_files(
    spark: SparkSession, directory: str, recursive: bool = True, max_files_per_trigger: int | None = None
) -> DataFrame:
    """A stream of the text files that arrive in a directory as Spark's own source sees them; a rate of None takes all that there are.

    Names with ``.`` or ``_`` in front and files without a byte don't arrive.
    """
    stream = (
        spark.readStream.format("binaryFile")
        .schema(schemas.FILES)
        .option("pathGlobFilter", text_glob())
        .option("recursiveFileLookup", str(recursive).lower())
    )
    if max_files_per_trigger is not None:
        stream = stream.option("maxFilesPerTrigger", max_files_per_trigger)
    return stream.load(directory)


def _file_writer(results: DataFrame, directory: str, checkpoint: str) -> DataStreamWriter:
    return (
        results.writeStream.format("parquet")
        .option("path", directory)
        .option("checkpointLocation", checkpoint)
    )


def write_stream(
    results: DataFrame, directory: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Append result rows to Parquet files, each exactly once.

    ``checkpoint`` has to be on storage that all executors share and that outlives the query.
    """
    return _file_writer(results, directory, checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def scan_stream(
    spark: SparkSession,
    landing: str,
    directory: str,
    checkpoint: str,
    scanner: Scanner = Scanner(),
    recursive: bool = True,
    trigger: dict | None = None,
    list_seconds: float = 60.0,
) -> StreamingQuery:
    """Scan every file that lands in a directory by itself and append its result, as a scan of the directory gives it.

    The directory is listed at the start; a trigger that doesn't end lists it again every so many seconds.
    Where a model's chunks are spread, each micro-batch is scanned as a table and replaces its own
    ``batch_id`` directory, so a repeated batch writes nothing twice. Files over the limit are not read. Stores that
    only Spark's readers can open are served by ``write_stream(scan_files(landing_files(...)))``.
    """
    arrived = arriving_files(spark, landing, checkpoint, scanner.settings.max_file_bytes, recursive)
    documents = gate_arrived(arrived, scanner.settings)
    if isinstance(scanner.scorer, ModelScorer) and scanner.spread_chunks is not None:

        def scan_batch(batch: DataFrame, batch_id: int) -> None:
            results = scanner.scan_documents(batch, ["file"])
            results.write.mode("overwrite").parquet(f"{directory}/batch_id={batch_id}")

        writer = documents.writeStream.foreachBatch(scan_batch).option("checkpointLocation", checkpoint)
    else:
        writer = _file_writer(scanner.scan_documents(documents, ["file"]), directory, checkpoint)
    if trigger is None or {"availableNow", "once"} & set(trigger):
        return run_available(writer)
    query = writer.trigger(**trigger).start()
    keep_listing(query, spark, landing, checkpoint, list_seconds, recursive)
    return query
