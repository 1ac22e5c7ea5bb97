"""Summaries and reports over result rows.

A report is built inside the row of its document; only the global counts aggregate, and those have
a handful of keys that are counted before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.functions.columns import compute_once, fixed, let

SHOWN_PER_LABEL = 10

_UNKNOWN = "<unknown file>"


def summarise(results: DataFrame) -> DataFrame:
    """One row ``(total_files, files_with_pii, total_pii, errors)``."""
    succeeded = F.col("status") == "success"
    return results.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(succeeded & (F.col("pii_count") > 0)).alias("files_with_pii"),
        F.coalesce(F.sum(F.when(succeeded, F.col("pii_count"))), F.lit(0)).alias("total_pii"),
        F.count_if(F.col("status") == "error").alias("errors"),
    )


def count_statuses(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("files"))


def entity_rows(results: DataFrame, ids: Sequence[str]) -> DataFrame:
    """One row per entity with its position ``ord`` in the document."""
    rows = results.select(*ids, F.posexplode_outer("entities").alias("ord", "entity"))
    return rows.filter(F.col("entity").isNotNull()).select(*ids, "ord", "entity.*")


def count_labels(results: DataFrame) -> DataFrame:
    """Entities of each label over all results."""
    labels = results.select(
        F.explode_outer(F.transform("entities", lambda e: e.label)).alias("label")
    ).filter(F.col("label").isNotNull())
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("entities"))


def confidence_band(score: Column) -> Column:
    return (
        F.when(score > F.lit(0.7).cast("float"), "high")
        .when(score > F.lit(0.5).cast("float"), "medium")
        .otherwise("low")
    )


def headline(file: Column, pii_count: Column) -> Column:
    name = F.coalesce(file, F.lit(_UNKNOWN))
    found = F.concat(F.lit(" ("), pii_count.cast("string"), F.lit(" entities)"))
    return F.concat(name, F.when(pii_count > 0, found).otherwise(F.lit(" (no PII detected)")))


def is_visible(status: Column, pii_count: Column, show_all: bool) -> Column:
    """Errors always show; other results do with ``show_all``, or if they hold PII."""
    return (status == "error") | F.lit(show_all) | ((status == "success") & (pii_count > 0))


def group_by_label(entities: Column, shown: int = SHOWN_PER_LABEL) -> Column:
    """``array<struct<label, count, top, more>>`` of one document, in the order of the labels.

    ``top`` holds the first entities in document order and ``more`` how many are left out there.
    """

    def group(label: Column) -> Column:
        return let(
            F.filter(entities, lambda e: e.label == label),
            lambda own: F.struct(
                label.alias("label"),
                F.size(own).alias("count"),
                F.transform(
                    F.slice(own, 1, shown),
                    lambda e: F.struct(
                        e.text.alias("text"),
                        fixed(e.score, 2).alias("confidence"),
                        confidence_band(e.score).alias("band"),
                    ),
                ).alias("top"),
                F.greatest(F.size(own) - F.lit(shown), F.lit(0)).alias("more"),
            ),
        )

    labels = F.sort_array(F.array_distinct(F.transform(entities, lambda e: e.label)))
    return F.transform(labels, group)


def report(results: DataFrame, file: str = "file", show_all: bool = False) -> DataFrame:
    """The visible results with headline, message, and entities grouped by label."""
    visible = results.filter(is_visible(F.col("status"), F.col("pii_count"), show_all))
    name = F.col(file).cast("string")
    return compute_once(
        visible,
        headline=F.when(F.col("status") == "success", headline(name, F.col("pii_count"))).otherwise(
            F.coalesce(name, F.lit(_UNKNOWN))
        ),
        by_label=group_by_label(F.col("entities")),
    ).select(file, "status", "headline", F.col("error").alias("message"), "by_label")


def report_rows(reported: DataFrame, file: str = "file") -> DataFrame:
    """One row per document and label of a report."""
    rows = reported.select(file, F.explode_outer("by_label").alias("group"))
    return rows.filter(F.col("group").isNotNull()).select(file, "group.*")
