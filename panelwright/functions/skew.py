"""Exact joins on keys that may be very frequent on the left: heavy keys are cut into pieces.

Left rows of a heavy key take one of its pieces by a hash of their own id; the matching right rows
are repeated once per piece. Every left row still meets each of its right rows exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions.sizing import broadcast_if_small
from panelwright.session import durable

ROWS_PER_PIECE = 50_000
PIECE = "_key_piece"


def heavy_keys(rows: DataFrame, key: str, rows_per_piece: int = ROWS_PER_PIECE) -> DataFrame:
    """(key, _pieces) of keys with more rows than one piece holds; stored, as both sides use it."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > rows_per_piece)
    pieces = F.ceil(F.col("_rows") / rows_per_piece).cast("int")
    return broadcast_if_small(durable(counts.select(key, pieces.alias("_pieces"))))


def with_piece(rows: DataFrame, heavy: DataFrame, key: str, row_id: str) -> DataFrame:
    """Left side: the piece of each row, 0 for ordinary keys."""
    joined = rows.join(heavy, key, "left")
    piece = F.pmod(F.xxhash64(row_id), F.coalesce("_pieces", F.lit(1))).cast("int")
    return joined.select(*rows.columns, piece.alias(PIECE))


def with_copies(side: DataFrame, heavy: DataFrame, key: str) -> DataFrame:
    """Right side: one copy per piece of its key."""
    joined = side.join(heavy, key, "left")
    every = F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1)
    return joined.select(*side.columns, F.explode(every).alias(PIECE))
