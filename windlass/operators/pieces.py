"""Station sequences in (station, day) pieces that carry the rows before them.

A lag or a rolling window needs a few earlier rows of the same station. ``with_halo`` cuts each station into pieces of one
day (any non-decreasing function of the order column) and puts in front of every piece a halo: copies of the
last ``back`` rows before it, from as many earlier pieces as that takes. Windows then run inside a piece, so a
station with most of the rows is spread over as many tasks as it has days, at every size and without a copy per lag.

Only the last ``back`` rows of a piece leave it (a top-k limit before the shuffle); the table of these tails, one row a piece, is
windowed per station. Rows of equal time stand in the order of ``tie``; rows without a time are a station's last piece.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

PIECE, OWN = "__piece", "__own"


def tie_column(columns: Sequence[str], key: str = "station", order: str = "time") -> str | None:
    """The column that orders rows of equal time by default: the first one besides key and order."""
    return next((c for c in columns if c not in (key, order)), None)


def with_halo(df: DataFrame, back: int, cols: Sequence[str], key: str = "station", order: str = "time",
              tie: str | None = None, chunk: Column | None = None) -> DataFrame:
    """``df`` with its piece and an ``OWN`` flag, plus the halo rows (flag false), which hold key, order, tie and ``cols``."""
    tie = tie or tie_column(df.columns, key, order)
    rows = df.withColumn(PIECE, chunk if chunk is not None else F.to_date(order))
    if back < 1:
        return rows.withColumn(OWN, F.lit(True))
    ordered = [order] + ([tie] if tie else [])
    held = list(dict.fromkeys([*ordered, *cols]))
    newest = Window.partitionBy(key, PIECE).orderBy(*[F.col(c).desc() for c in ordered])
    last = (rows.select(key, PIECE, *held).withColumn("__nth", F.row_number().over(newest)).filter(F.col("__nth") <= back))
    tails = last.groupBy(key, PIECE).agg(F.sort_array(F.collect_list(F.struct("__nth", F.struct(*held).alias("__row")))).alias("__tail"))
    # newest piece first, and newest row first within it: the first ``back`` of them are the halo
    before = Window.partitionBy(key).orderBy(F.col(PIECE).desc_nulls_first()).rowsBetween(1, back)
    halo = tails.withColumn("__tails", F.collect_list("__tail").over(before))
    halo = halo.select(key, PIECE, F.explode(F.slice(F.flatten("__tails"), 1, back)).alias("__t"))
    halo = halo.select(key, PIECE, *[F.col("__t.__row")[c].alias(c) for c in held], F.lit(False).alias(OWN))
    return rows.withColumn(OWN, F.lit(True)).unionByName(halo, allowMissingColumns=True)


def piece_window(columns: Sequence[str], key: str = "station", order: str = "time", tie: str | None = None) -> WindowSpec:
    """The window over a piece and its halo; ``columns`` are those of the table before ``with_halo``."""
    tie = tie or tie_column(columns, key, order)
    return Window.partitionBy(key, PIECE).orderBy(OWN, order, *([tie] if tie else []))


def own_rows(pieces: DataFrame) -> DataFrame:
    """The rows of the table itself, after the windows."""
    return pieces.filter(OWN).drop(PIECE, OWN)
