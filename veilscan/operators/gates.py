"""Gates a document passes before it is scanned: name, size, and content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilscan.functions.columns import fixed, is_blank
from veilscan.settings import BYTES_PER_MB, Settings

# Extensions of the files that are scanned.
TEXT_EXTENSIONS = [
    "txt", "json", "xml", "csv", "log", "md", "py", "js", "java", "cpp", "c", "h", "html", "css",
    "yaml", "yml", "ini", "conf", "config", "sql", "sh", "bash", "env",
]

EMPTY = "Empty file"


def is_text_path(path: Column) -> Column:
    """Whether the last extension of a path is scanned; a leading dot starts no extension."""
    extension = F.regexp_extract(path, r"[^/]\.([^./]+)\z", 1)
    return F.lower(extension).isin(TEXT_EXTENSIONS)


def text_glob() -> str:
    """The same predicate as a file glob, so that other files are dropped while listing."""
    any_case = ["".join(f"[{c}{c.upper()}]" for c in name) for name in TEXT_EXTENSIONS]
    return "*.{" + ",".join(any_case) + "}"


def too_large(length: Column, settings: Settings) -> Column:
    return length > F.lit(settings.max_file_bytes).cast("bigint")


def too_large_message(length: Column, settings: Settings) -> Column:
    limit = F.lit(settings.max_file_size_mb).cast("float")
    size = (length.cast("float") / F.lit(BYTES_PER_MB)).cast("float")
    return F.concat(
        F.lit("File too large ("), fixed(size, 1), F.lit("MB > "), fixed(limit, 1), F.lit("MB)")
    )


def empty_message(text: Column) -> Column:
    """Why a document of any size is skipped, or NULL if it is to be scanned."""
    return F.when(is_blank(text), F.lit(EMPTY))


def gate_message(text: Column, length: Column, settings: Settings) -> Column:
    """Why a document is skipped, or NULL if it is to be scanned."""
    return F.when(too_large(length, settings), too_large_message(length, settings)).when(
        is_blank(text), F.lit(EMPTY)
    )
