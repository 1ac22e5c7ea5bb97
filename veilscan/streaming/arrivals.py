"""A streaming source of files as they arrive, hidden and empty ones among them.

Spark's own file stream passes over names with ``.`` or ``_`` in front and files without a byte. Here
an offset is a number of listings, kept in a log beside the checkpoint. A listing is made by the executors
as for a batch (:func:`list_tree`); what no earlier one holds is its arrivals, a table of paths and
sizes. Nothing of a listing passes through the driver, and offsets stay small.

A path arrives once. A listing counts once its mark is written, after its table, so one that is broken off is
made anew, and a micro-batch that is repeated reads the same arrivals.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.types import StructType

from veilscan.operators.gates import is_text_path
from veilscan.sources.listing import LISTED, absolute, list_tree, read_rows, resolved, status_of

#: Columns of the stream; content is NULL for what was not read: files over the limit, and directories that can't be listed.
ARRIVED = "path string, length long, kind string, content binary"
SOURCE = "veilscan_arrivals"
#: Arrivals of one task.
PART_ROWS = 256
_MARK = "_whole"


def _log(spark: SparkSession, checkpoint: str) -> str:
    return f"{absolute(spark, checkpoint)}-arrivals"


def _listings(log: str, n: int = 0) -> int:
    """How many listings a log holds, given that it holds n."""
    while True:
        system, name = resolved(f"{log}/{n}/{_MARK}")
        if system.get_file_info(name).type == fs.FileType.NotFound:
            return n
        n += 1


def list_arrivals(spark: SparkSession, directory: str, checkpoint: str, recursive: bool = True) -> int:
    """List a directory and log the text files, and the directories that can't be listed, that are new; returns the number of listings.

    A running stream with this checkpoint goes on with them.
    """
    status_of(absolute(spark, directory))
    log = _log(spark, checkpoint)
    n = _listings(log)
    found = list_tree(spark, directory, recursive)
    found = found.filter((F.col("kind") != "file") | is_text_path(F.col("path")))
    if n:
        before = spark.read.schema(LISTED).parquet(*[f"{log}/{k}" for k in range(n)])
        found = found.join(before.select("path"), "path", "left_anti")
    rows = found.select("path", "length", "kind").write.mode("overwrite")
    rows.option("maxRecordsPerFile", 100 * PART_ROWS).parquet(f"{log}/{n}")
    system, name = resolved(f"{log}/{n}/{_MARK}")
    with system.open_output_stream(name) as mark:
        mark.write(b"")
    return n + 1


class _Part(InputPartition):
    """Some rows of a file of a listing's table."""

    def __init__(self, table: str, first: int, rows: int) -> None:
        self.table, self.first, self.rows = table, first, rows


class ArrivalReader(DataSourceStreamReader):
    """Reads what listings hold; the executors open the files."""

    def __init__(self, options: dict) -> None:
        self.log, self.limit = options["log"], int(options["limit"])
        self.known = 0

    def initialOffset(self) -> dict:
        return {"listings": 0}

    def latestOffset(self) -> dict:
        self.known = _listings(self.log, self.known)
        return {"listings": self.known}

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        """Told by the footers of the listings' files; only numbers of rows reach the driver."""
        parts = []
        for n in range(start["listings"], end["listings"]):
            system, name = resolved(f"{self.log}/{n}")
            for info in system.get_file_info(fs.FileSelector(name)):
                if info.extension == "parquet":
                    with system.open_input_file(info.path) as file:
                        rows = pq.ParquetFile(file).metadata.num_rows
                    table = f"{self.log}/{n}/{info.base_name}"
                    parts += [_Part(table, at, min(PART_ROWS, rows - at)) for at in range(0, rows, PART_ROWS)]
        return parts

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        system, name = resolved(partition.table)
        with system.open_input_file(name) as file:
            rows = pq.read_table(file).select(["path", "length", "kind"]).slice(partition.first, partition.rows)
        yield from read_rows(rows.to_pylist(), self.limit)


class ArrivalSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return SOURCE

    def schema(self) -> str:
        return ARRIVED

    def streamReader(self, schema: StructType) -> ArrivalReader:
        return ArrivalReader(self.options)


def arriving_files(spark: SparkSession, directory: str, checkpoint: str, limit: int, recursive: bool = True) -> DataFrame:
    """A stream of ARRIVED rows, with all that a directory holds now; files of more than ``limit`` bytes are not read.

    ``checkpoint`` is that of the query which reads the stream.
    """
    list_arrivals(spark, directory, checkpoint, recursive)
    spark.dataSource.register(ArrivalSource)
    return spark.readStream.format(SOURCE).options(log=_log(spark, checkpoint), limit=limit).load()


def run_available(writer: DataStreamWriter) -> StreamingQuery:
    """Start a query that ends when it has taken all that is listed.

    Spark's own trigger for that takes one micro-batch of such a source, which after a failure is the repeated one alone.
    """
    query = writer.trigger(processingTime="0 seconds").start()

    def run() -> None:
        try:
            query.processAllAvailable()
        except StreamingQueryException:
            return  # the query tells it
        query.stop()

    threading.Thread(target=run, daemon=True).start()
    return query


def keep_listing(query: StreamingQuery, spark: SparkSession, directory: str, checkpoint: str, seconds: float, recursive: bool = True) -> threading.Thread:
    """List a directory every so many seconds for as long as a query runs."""

    def run() -> None:
        while not query.awaitTermination(seconds):
            list_arrivals(spark, directory, checkpoint, recursive)

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    return thread
