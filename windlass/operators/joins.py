"""Join helpers: size-checked broadcast, semi/anti splits, label grids, reindexing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Broadcast only below this many rows *and* this many estimated bytes.
BROADCAST_MAX_ROWS = 2_000_000
BROADCAST_MAX_BYTES = 64 * 1024 * 1024


def _row_bytes(df: DataFrame) -> int:
    """Rough in-memory row width: 8 bytes per fixed-width value, 32 per string or nested value."""
    from pyspark.sql.types import AtomicType, StringType
    return sum(32 if isinstance(f.dataType, StringType) or not isinstance(f.dataType, AtomicType) else 8
               for f in df.schema.fields) + 16


def maybe_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS,
                    max_bytes: int = BROADCAST_MAX_BYTES, known_rows: int | None = None) -> DataFrame:
    """Hint a broadcast only after counting the side: above the bound the join stays a
    shuffled hash/sort-merge join (and AQE may still convert it at run time)."""
    n = df.count() if known_rows is None else known_rows
    if n <= max_rows and n * _row_bytes(df) <= max_bytes:
        return F.broadcast(df)
    return df


def semi(df: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows whose key is in ``keys``."""
    return df.join(keys, on, "left_semi")


def anti(df: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows whose key is not in ``keys``."""
    return df.join(keys, on, "left_anti")


def not_in_keep_null(col: str, values: Sequence) -> F.Column:
    """Pandas ``~isin``: null keys are kept (Spark's NOT IN would drop them)."""
    return ~F.coalesce(F.col(col).isin(list(values)), F.lit(False))


def reindex(df: DataFrame, order: DataFrame, key: str, position: str = "position") -> DataFrame:
    """Results in a fixed key order; keys absent from ``df`` appear as null rows."""
    return order.join(df, key, "left").orderBy(position)
