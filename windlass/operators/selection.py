"""Row selections of the interactive views, as predicates.

Each returns a boolean Column, so it can filter (pushed down by Catalyst where it touches
scan columns) or flag rows (``highlight``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def point_selection(col, keys: Sequence | None) -> Column:
    """Rows whose key is in the chosen set; an empty or missing set selects every row."""
    if not keys:
        return F.lit(True)
    return _c(col).isin(list(keys))


def interval_selection(col, lo: float | None, hi: float | None) -> Column:
    """Closed range on one field; None bounds are open."""
    c = _c(col)
    cond = F.lit(True)
    if lo is not None:
        cond = cond & (c >= F.lit(float(lo)))
    if hi is not None:
        cond = cond & (c <= F.lit(float(hi)))
    return cond


def box_selection(x, y, x_range, y_range) -> Column:
    """2-D box on two fields (e.g. longitude x latitude)."""
    return interval_selection(x, *x_range) & interval_selection(y, *y_range)


def highlight(df: DataFrame, cond: Column, name: str = "selected") -> DataFrame:
    """Keep every row and flag the selected ones (null comparisons count as not selected)."""
    return df.withColumn(name, F.coalesce(cond, F.lit(False)))


def select_rows(df: DataFrame, cond: Column) -> DataFrame:
    return df.filter(cond)


def pick_id(df: DataFrame, id_col: str, value: int) -> DataFrame:
    """One row by its running id (slider)."""
    return df.filter(F.col(id_col) == F.lit(value))
