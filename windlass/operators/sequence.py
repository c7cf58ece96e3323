"""Row-offset access within a station's time series.

``with_lags`` adds ``{col}_lag{k}`` columns (the value k rows earlier in the same station, rows ordered by time, then by a tie
column). It works on (station, day) pieces with a halo (``operators.pieces``), at every size: no station is one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windlass.operators.pieces import own_rows, piece_window, tie_column, with_halo
from windlass.operators.temporal import lag_block


def with_lags(df: DataFrame, cols: Sequence[str], lags: Sequence[int], key: str = "station",
              order: str = "time", tie: str | None = None, chunk: Column | None = None) -> DataFrame:
    """Lags of ``cols`` in ``order``, rows of equal order by ``tie`` (default: the first other column)."""
    tie, lags = tie or tie_column(df.columns, key, order), sorted(set(lags))
    pieces = with_halo(df, max(lags, default=0), cols, key, order, tie, chunk)
    return lags_in_pieces(pieces, cols, lags, piece_window(df.columns, key, order, tie))


def lags_in_pieces(pieces: DataFrame, cols: Sequence[str], lags: Sequence[int], w) -> DataFrame:
    """The lags of a table that already has its halo (``with_halo``, or a stored layout)."""
    return own_rows(lag_block(pieces, list(cols), list(lags), w))


def ref(col: str, offset: int):
    """Column of ``col`` ``offset`` rows back (0 = the row itself) after ``with_lags``."""
    return F.col(col) if offset == 0 else F.col(f"{col}_lag{offset}")


def mean_of(values) -> F.Column:
    """Mean of the non-null values (null when none) -- a rolling mean with min_periods=1."""
    n = sum((F.when(v.isNotNull(), 1).otherwise(0) for v in values), F.lit(0))
    s = sum((F.coalesce(v, F.lit(0.0)) for v in values), F.lit(0.0))
    return F.when(n > 0, s / n)


def std_of(values, fill: float | None = 0.0) -> F.Column:
    """Sample standard deviation of the non-null values; fewer than two -> ``fill``."""
    n = sum((F.when(v.isNotNull(), 1).otherwise(0) for v in values), F.lit(0))
    m = mean_of(values)
    ss = sum((F.coalesce(F.pow(v - m, 2), F.lit(0.0)) for v in values), F.lit(0.0))
    sd = F.when(n >= 2, F.sqrt(ss / (n - 1)))
    return F.coalesce(sd, F.lit(fill)) if fill is not None else sd
