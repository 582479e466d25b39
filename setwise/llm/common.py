"""Shared plumbing of the operators: batch bounds, text columns, the held-out fifth."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..storage import Scratch, shared_dir

__all__ = ["Scratch", "shared_dir", "bound_batches", "text_or_empty", "ascii_lower", "held_out", "partitions"]

#: Rows in one Arrow batch sent to Python: bounds a worker's memory when texts are very long.
ARROW_ROWS = 256


def bound_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Lower the Arrow batch size to ``rows`` where the session still has more."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("string")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII texts take the byte-wise path."""
    upper, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, small))


def held_out(doc_id: Column) -> Column:
    """True for the fifth of rows kept out of learning: crc32(doc_id as text) mod 5 is 0 (null ids learn)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
