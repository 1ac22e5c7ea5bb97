"""Writing of results and of the response of a scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.plans.report import summarise


def result_json(*columns: str) -> Column:
    """One result row as a JSON object that keeps its null fields."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def write_response(results: DataFrame, directory: str, format: str = "json") -> None:
    """Write all results to ``directory/results`` and their summary to ``directory/summary``.

    The summary is taken from the written results, so nothing is scanned twice.
    """
    spark = results.sparkSession
    written = f"{directory}/results"
    results.write.mode("overwrite").option("ignoreNullFields", "false").format(format).save(written)
    stored = spark.read.schema(results.schema).format(format).load(written)
    summary = summarise(stored).coalesce(1)
    summary.write.mode("overwrite").format(format).save(f"{directory}/summary")
