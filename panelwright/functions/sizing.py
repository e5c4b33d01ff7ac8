"""Broadcast only what a count has shown to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BROADCAST_ROWS = 20_000
MAX_BROADCAST_BYTES = 32_000_000
TEXT_BYTES, COLLECTION_ITEMS = 32, 16


def row_width(kind: T.DataType) -> int:
    """Estimated bytes of a value: 8 for a number, a usual length for text and collections, the sum of the fields for a row."""
    if isinstance(kind, T.StructType):
        return 8 + sum(row_width(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return 8 + COLLECTION_ITEMS * row_width(kind.elementType)
    if isinstance(kind, T.MapType):
        return 8 + COLLECTION_ITEMS * (row_width(kind.keyType) + row_width(kind.valueType))
    return TEXT_BYTES if isinstance(kind, (T.StringType, T.BinaryType)) else 8


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast when df has at most max_rows rows and, at the width of its schema, max_bytes; else leave the join to a shuffle.

    Meant for fitted statistics that were made durable first, so the probe reads a few stored rows.
    """
    most = min(max_rows, max_bytes // row_width(df.schema))
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def bounded_rows(df: DataFrame, max_rows: int, what: str) -> list:
    """Bring a small fitted table to the driver, and refuse when it is not small."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"{what}: more than {max_rows} rows; raise the bound or use the join form")
    return rows
