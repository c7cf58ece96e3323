"""Reshaping: pivot by rank, unpivot/fold, renames, column drops and schema alignment
(A12, U5, U6, P2-P4, P10-P12)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], var: str, value: str) -> DataFrame:
    """Wide -> long (pandas ``melt``); one output row per (input row, value column)."""
    return df.unpivot(list(ids), list(values), var, value)


def pivot_ranks(df: DataFrame, index: Sequence[str], rank_col: str, ranks: Sequence[int],
                values: Sequence[str]) -> DataFrame:
    """Rows (index, rank) -> one row per index with ``{value}_{rank}`` columns.

    The rank list is passed explicitly, which spares Spark the extra job that finds the
    distinct pivot values. ``first`` is exact because (index, rank) is unique after A11.
    """
    p = df.groupBy(*index).pivot(rank_col, list(ranks)).agg(*[F.first(v).alias(v) for v in values])
    ren = {f"{r}_{v}": f"{v}_{r}" for r in ranks for v in values}
    if len(values) == 1:
        ren = {str(r): f"{values[0]}_{r}" for r in ranks}
    return p.withColumnsRenamed(ren)


def drop_matching(df: DataFrame, pattern: str) -> DataFrame:
    """Drop every column whose name contains ``pattern``."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if pattern not in c])


def drop_present(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop listed columns; absent names are ignored."""
    return df.drop(*cols)


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename by map (names absent from the frame are ignored)."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def scale(df: DataFrame, cols: Sequence[str], factor: float = 0.1) -> DataFrame:
    """Multiply many columns at once (tenths -> units by default)."""
    present = [c for c in cols if c in df.columns]
    return df.withColumns({c: F.col(f"`{c}`") / F.lit(1.0 / factor) for c in present})


def align_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Add absent optional columns as typed nulls and order columns as in ``schema``."""
    cols = []
    for f in schema.fields:
        if f.name in df.columns:
            cols.append(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def drop_all_null_columns(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """P10: drop columns that are null in every row -- one aggregation pass for all columns."""
    cols = list(cols or df.columns)
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in cols]).first()
    return df.drop(*[c for c in cols if counts[c] == 0])


def drop_any_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """P7 on wide tables: rows with a null in any of ``cols`` (default: all) dropped, by one opaque condition. A null filter per column
    makes the optimizer derive constraints for every alias of hundreds of columns, which takes it minutes."""
    return df.filter(~F.exists(F.array(*[F.col(f"`{c}`").isNull() for c in cols or df.columns]), lambda x: x))
