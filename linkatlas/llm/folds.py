"""Folds by checksum and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(parts: int) -> Column:
    """crc32 of doc_id as text, modulo ``parts``; a null id falls in fold 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts, F.lit(0))


def bounded_sample(rows: DataFrame, most: int, seed: int = 11) -> DataFrame:
    """All of ``rows`` if at most ``most``, else those whose hashed doc_id falls in the share that keeps about ``most``."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) < int((1 << 30) * most / n))
