"""Scan settings, their defaults, and how a request overrides them."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A hard cut backs off by up to three bytes to stay between code points, so a smaller
# chunk could fail to move forward.
MIN_CHUNK_SIZE = 4

BYTES_PER_MB = 1024 * 1024


@dataclass(frozen=True)
class Settings:
    """Options of one scan. Sizes are bytes unless the name says otherwise."""

    threshold: float = 0.3
    max_chunk_size: int = 8000
    batch_size: int = 8
    max_file_size_mb: float = 50.0
    filter_false_positives: bool = True

    def __post_init__(self) -> None:
        if self.max_chunk_size < MIN_CHUNK_SIZE:
            raise ValueError(f"max_chunk_size must be at least {MIN_CHUNK_SIZE}")
        if self.batch_size < 1:
            raise ValueError("batch_size must be at least 1")

    def merged(self, **overrides) -> "Settings":
        """A copy in which every override that is not None replaces the base value."""
        return dataclasses.replace(self, **{k: v for k, v in overrides.items() if v is not None})

    @property
    def max_file_bytes(self) -> int:
        """Largest byte length the size gate lets through.

        Sizes are compared as 32-bit MB, which is monotone in the length, so the gate is the
        same as one integer comparison, and that reaches a file scan as a pushed filter.
        """
        limit = np.float32(self.max_file_size_mb)
        low, high = -1, 2**62
        while high - low > 1:
            middle = (low + high) // 2
            if np.float32(middle) / np.float32(BYTES_PER_MB) > limit:
                high = middle
            else:
                low = middle
        return low


def merge_settings(requests: DataFrame, base: Settings = Settings()) -> DataFrame:
    """Effective settings of each row of a request table: override if given, else base."""
    return requests.withColumns(
        {
            "threshold": F.coalesce("threshold", F.lit(base.threshold).cast("float")),
            "chunk_size": F.coalesce("chunk_size", F.lit(base.max_chunk_size)),
            "batch_size": F.coalesce("batch_size", F.lit(base.batch_size)),
            "max_file_size": F.coalesce("max_file_size", F.lit(base.max_file_size_mb).cast("float")),
            "filter_false_positives": F.coalesce(
                "filter_false_positives", F.lit(base.filter_false_positives)
            ),
        }
    )
