"""Scanning tables: documents in, one result row per document out.

The whole scan is a projection. Each document is gated, cut, scored and decoded inside its row, so no
stage shuffles and no key can be hot. A model takes the chunks of a row as an array and gives its spans back.
Where single documents are too large for a task, ``spread_chunks`` makes a model work on chunk rows,
which are dealt out evenly, and brings the entities of a document back together by its id.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan import schemas
from veilscan.functions.columns import compute_once
from veilscan.functions.labels import resolve_labels, unsupported_labels
from veilscan.operators.chunking import chunk_text
from veilscan.operators.decoding import chunk_entities, span_entities
from veilscan.operators.false_positives import DEFAULT_RULES, FalsePositiveRule
from veilscan.operators.gates import empty_message, gate_message
from veilscan.operators.model_scorer import ModelScorer
from veilscan.operators.pattern_scorer import PatternScorer
from veilscan.operators.row_scan import scan_texts
from veilscan.settings import Settings


@dataclass(frozen=True)
class Scanner:
    """What to look for and how; the same scanner serves tables, files and streams."""

    labels: tuple[str, ...] = field(default_factory=lambda: tuple(resolve_labels()))
    settings: Settings = Settings()
    scorer: PatternScorer | ModelScorer = PatternScorer()
    filters: bool = True
    rules: tuple[FalsePositiveRule, ...] = DEFAULT_RULES
    # Deal the rows of a table out over this many tasks before they are scanned; None leaves them in place.
    partitions: int | None = None
    # Skip texts of a table that are over the settings' file size, as files are; else only files have a limit.
    limit_texts: bool = False
    # Deal chunk rows out over this many tasks before a model sees them; None leaves chunks in their document's row.
    spread_chunks: int | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "labels", tuple(self.labels))
        object.__setattr__(self, "rules", tuple(self.rules))

    @staticmethod
    def for_request(
        labels: Sequence[str] | None = None,
        profile: str | None = None,
        extended: bool = False,
        private: bool = False,
        log: bool = False,
        base: Settings = Settings(),
        overrides: dict | None = None,
        **options,
    ) -> "Scanner":
        """A scanner for the options of one request, laid over the base settings."""
        return Scanner(
            labels=tuple(resolve_labels(labels, profile, extended, private, log)),
            settings=base.merged(**(overrides or {})),
            **options,
        )

    @property
    def unsupported_labels(self) -> list[str]:
        return unsupported_labels(self.labels, self.scorer.vocabulary)

    def _decode(self, tokens: Column, text: Column, offset: Column) -> Column:
        return chunk_entities(
            tokens,
            text,
            offset,
            self.labels,
            self.settings,
            self.filters,
            self.rules,
        )

    def scan_documents(self, documents: DataFrame, ids: Sequence[str]) -> DataFrame:
        """Results of rows ``(*ids, text, file_size_bytes, error)``.

        A row whose ``error`` is set is not scanned; its status is taken from the row.
        """
        if isinstance(self.scorer, ModelScorer) and self.spread_chunks is not None:
            return self._scan_chunk_rows(documents, ids)
        # False positives are judged before entities are deduplicated, by column expressions.
        if hasattr(self.scorer, "finder") and not (self.filters and self.settings.filter_false_positives):
            return self._scan_in_batches(documents, ids)
        return self._scan_in_row(documents, ids)

    def _scan_in_batches(self, documents: DataFrame, ids: Sequence[str]) -> DataFrame:
        text = F.when(F.col("status") == "success", F.col("text"))
        find = self.scorer.finder(self.labels, self.settings)
        found = scan_texts(text, find, self.scorer.vocabulary, self.settings.max_chunk_size)
        scanned = compute_once(documents, found=found)
        return scanned.select(
            *ids,
            "status",
            F.col("found.entities").alias("entities"),
            F.size("found.entities").cast("bigint").alias("pii_count"),
            "file_size_bytes",
            F.col("found.chunks").alias("chunks_processed"),
            "error",
        )

    def _scan_in_row(self, documents: DataFrame, ids: Sequence[str]) -> DataFrame:
        chunks, entities = _in_row_columns(self, documents.sparkSession)
        chunked = compute_once(documents, chunks=chunks).select(*ids, "status", "chunks", "file_size_bytes", "error")
        if isinstance(self.scorer, ModelScorer):
            texts = F.transform("chunks", lambda c: c.text)
            spans = self.scorer.spans(texts, self.labels, self.settings.threshold, self.settings.batch_size)
            chunked = compute_once(chunked, spans=spans)
        scanned = compute_once(chunked, entities=entities)
        return scanned.select(
            *ids,
            "status",
            "entities",
            F.size("entities").cast("bigint").alias("pii_count"),
            "file_size_bytes",
            F.size("chunks").alias("chunks_processed"),
            "error",
        )

    def _scan_chunk_rows(self, documents: DataFrame, ids: Sequence[str]) -> DataFrame:
        if documents.isStreaming:
            raise ValueError("A model scans a stream batch by batch; use scan_stream")
        # A group is one document: its ids, its text, and the partition it was read in. Should the
        # ids not tell rows apart, copies of a row meet only within their partition, where equal
        # chunks fold into one and their number is kept, so that no group outgrows a document.
        carried = [*ids, "status", "file_size_bytes", "error", "_text_hash", "_partition"]
        marked = documents.select(
            "*",
            F.xxhash64("text").alias("_text_hash"),
            F.spark_partition_id().alias("_partition"),
        )
        scored = self.score_chunks(marked, carried)
        entities = compute_once(
            scored, entities=self._decode(F.col("tokens"), F.col("text"), F.col("offset"))
        )
        # Skipped documents have one row without a chunk; NULL is not collected.
        part = F.when(F.col("chunk_idx").isNotNull(), F.struct("chunk_idx", "entities"))
        gathered = entities.groupBy(*carried).agg(
            F.sort_array(F.collect_set(part)).alias("parts"),
            F.count_if(F.coalesce("chunk_idx", F.lit(0)) == 0).alias("copies"),
        )
        # A model that does not repeat itself exactly leaves several versions of a chunk of copies.
        whole = gathered.withColumn(
            "parts",
            F.filter(
                "parts",
                lambda p, i: F.coalesce(
                    F.get(F.col("parts"), i - F.lit(1)).chunk_idx != p.chunk_idx, F.lit(True)
                ),
            ),
        )
        found = compute_once(
            whole, entities=F.flatten(F.transform("parts", lambda part: part.entities))
        )
        return found.select(
            *ids,
            "status",
            "entities",
            F.size("entities").cast("bigint").alias("pii_count"),
            "file_size_bytes",
            F.size("parts").alias("chunks_processed"),
            "error",
            F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"),
        ).drop("_copy")

    def score_chunks(self, documents: DataFrame, carried: Sequence[str]) -> DataFrame:
        """Chunk rows with the tokens of the model scorer."""
        chunks = F.when(
            F.col("status") == "success", chunk_text(F.col("text"), self.settings.max_chunk_size)
        )
        rows = documents.select(*carried, F.inline_outer(chunks))
        if self.spread_chunks is not None:
            rows = rows.repartition(self.spread_chunks)
        return rows.withColumn(
            "tokens", self.scorer.tokens(F.col("text"), self.settings.batch_size)
        )


@lru_cache(maxsize=64)
def _in_row_columns(scanner: Scanner, session) -> tuple[Column, Column]:
    """Chunks of ``text`` and entities of ``chunks``.

    They depend on the scanner alone, and are large enough that it pays to build them only once for
    all scans of a session.
    """
    none = F.array().cast(f"array<{schemas.CHUNK}>")
    chunks = F.when(
        F.col("status") == "success", chunk_text(F.col("text"), scanner.settings.max_chunk_size)
    ).otherwise(none)

    def entities_of(c: Column, k: Column) -> Column:
        if isinstance(scanner.scorer, ModelScorer):
            spans = F.get("spans", k)
            return span_entities(spans, c.text, c.offset, scanner.settings, scanner.filters, scanner.rules)
        return scanner._decode(scanner.scorer.tokens(c.text), c.text, c.offset)

    return chunks, F.flatten(F.transform("chunks", entities_of))


def gate_table(
    df: DataFrame, text_col: str, ids: Sequence[str], settings: Settings | None = None
) -> DataFrame:
    """Rows of a text table with the verdict of the empty gate and, given settings, of the size gate."""
    text = F.col("text")
    size = F.octet_length(text).cast("bigint")
    gated = compute_once(
        df.select(*ids, F.col(text_col).alias("text")).filter(text.isNotNull()),
        file_size_bytes=size,
        error=gate_message(text, size, settings) if settings else empty_message(text),
    )
    return gated.withColumn(
        "status", F.when(F.col("error").isNull(), F.lit("success")).otherwise(F.lit("skipped"))
    )


def scan_table(
    df: DataFrame, text_col: str, id_cols: str | Sequence[str], scanner: Scanner = Scanner()
) -> DataFrame:
    """Scan a column of text, in a batch or a stream; ``id_cols`` tell the rows apart.

    Returns the id columns followed by ``status, entities, pii_count, file_size_bytes,
    chunks_processed, error``. Rows without text are not documents and give no result.
    """
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    taken = {"text", "chunks", *schemas.RESULT_COLUMNS}.intersection(ids)
    if taken:
        raise ValueError(f"Rename the id columns {sorted(taken)}; results use these names")
    narrow = df.select(*ids, text_col)
    if scanner.partitions is not None:
        narrow = narrow.repartition(scanner.partitions)
    settings = scanner.settings if scanner.limit_texts else None
    return scanner.scan_documents(gate_table(narrow, text_col, ids, settings), ids)
