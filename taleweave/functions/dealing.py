"""Partitions that number with the rows, not with the bytes a shuffle makes of them.

Narrow rows pack so well that a shuffle's usual 64 MB hold millions of them, which
a task then sorts at many times that size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

ROWS = 1 << 19  # of a partition
FEW = 8  # partitions' rows that are left to Spark


def parts_of(rows: int) -> int | None:
    """How many partitions ``rows`` rows make; None for few."""
    return -(-rows // ROWS) if rows > FEW * ROWS else None


def dealt(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """``df`` in ``parts`` partitions by ``keys``, as it is for None."""
    return df.repartition(parts, *keys) if parts else df
