"""Time-series operators: per-station lags, differences and rolling windows (W1-W5), the
event-window join (J5), date spines for places without data (J9), running ids (W9) and
expanding time folds (W10).

Lags and rolling windows take a window spec: that of a (station, day) piece with a halo (``operators.pieces``) in all
registered queries. Positions within a station come from ``sequence_index``; neither puts a station in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def station_window(key: str | Sequence[str] = "station", order: Sequence[str] = ("time",)):
    keys = [key] if isinstance(key, str) else list(key)
    return Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in order])


# ---- W1-W5 ---------------------------------------------------------------------------------------
def lag_block(df: DataFrame, cols: Sequence[str], lags: Sequence[int], w) -> DataFrame:
    """``lag`` of many columns at several offsets as one struct per offset.

    len(lags) window expressions instead of len(cols) * len(lags); all share one window node.
    Result columns are named ``{col}_lag{k}``.
    """
    packed = F.struct(*[F.col(c) for c in cols])
    tmp = df.withColumns({f"__lag{k}": F.lag(packed, k).over(w) for k in lags})
    return tmp.withColumns({f"{c}_lag{k}": F.col(f"__lag{k}")[c] for k in lags for c in cols}) \
              .drop(*[f"__lag{k}" for k in lags])


def rolling_mean(col: str, w, rows: int = 3) -> Column:
    """Mean of the last ``rows`` rows, nulls skipped, at least one value (pandas min_periods=1)."""
    return F.avg(col).over(w.rowsBetween(-(rows - 1), 0))


def rolling_std(col: str, w, rows: int = 3, fill: float | None = 0.0) -> Column:
    """Sample std of the last ``rows`` rows; null (fewer than 2 values) -> ``fill``."""
    s = F.stddev_samp(col).over(w.rowsBetween(-(rows - 1), 0))
    return F.coalesce(s, F.lit(fill)) if fill is not None else s


# ---- skew-safe sequence index ------------------------------------------------------------------
def sequence_index(df: DataFrame, key: str, order: str, chunk: Column | None = None,
                   name: str = "seq", tie: str | None = None) -> DataFrame:
    """Position of each row within its key by ``order`` (0-based), without putting one key in one task.

    Rows are cut into (key, chunk) pieces -- by default one calendar day of ``order`` -- and
    numbered inside each piece. Piece sizes (one row per piece) are prefix-summed per key to
    give each piece its offset. A hot key is thus spread over as many tasks as it has pieces;
    only the piece table, far smaller than the data, is windowed per key.
    """
    chunk = chunk if chunk is not None else F.to_date(F.col(order))
    tie = [F.col(c) for c in ([tie] if tie else [c for c in df.columns if c not in (key, order)][:1])]
    pieces = df.withColumn("__chunk", chunk)
    w_in = Window.partitionBy(key, "__chunk").orderBy(F.col(order), *tie)
    local = pieces.withColumn("__rn", F.row_number().over(w_in) - 1)
    sizes = local.groupBy(F.col(key).alias("__k"), F.col("__chunk").alias("__c")).agg(F.count(F.lit(1)).alias("__n"))
    w_off = Window.partitionBy("__k").orderBy(F.col("__c").asc_nulls_last()) \
                  .rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("__off", F.coalesce(F.sum("__n").over(w_off), F.lit(0))).drop("__n")
    same = F.col(key).eqNullSafe(F.col("__k")) & F.col("__chunk").eqNullSafe(F.col("__c"))
    return (local.join(offsets, same)
            .withColumn(name, F.col("__off") + F.col("__rn"))
            .drop("__k", "__c", "__chunk", "__rn", "__off"))


# ---- J9 date spine -------------------------------------------------------------------------------
def date_spine(places: DataFrame, with_data: DataFrame, keys: Sequence[str], start: str, end: str,
               value_cols: dict[str, str]) -> DataFrame:
    """Every day in [start, end] for places that have *no* rows at all, values null."""
    missing = places.select(*keys).join(with_data.select(*keys).distinct(), list(keys), "left_anti")
    days = F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("INTERVAL 1 DAY")))
    return missing.select(*keys, days.alias("date"),
                          *[F.lit(None).cast(t).alias(c) for c, t in value_cols.items()])


# ---- J5 event-window join ------------------------------------------------------------------------
def event_window_join(events: DataFrame, obs: DataFrame, days: int = 3, event_date: str = "d",
                      station: str = "station", time: str = "time", **how) -> DataFrame:
    """Observations of each event's station within [date - days, date + days] (inclusive), by the interval join on (station, block)
    buckets, of which hot ones are salted (``operators.intervals``; ``how`` goes there). A block is as long as a window, so an event
    is shuffled in two copies at most, however long the window is."""
    from windlass.operators.intervals import interval_join
    how = {"block_hours": max(12, 48 * days)} | how
    lo, hi = F.date_sub(F.col(event_date), days).cast("timestamp_ntz"), F.date_add(F.col(event_date), days).cast("timestamp_ntz")
    return interval_join(events, obs, station, lo, hi, time, **how)


# ---- W9 / W10 ------------------------------------------------------------------------------------
def running_id(df: DataFrame, order: Sequence[Column], name: str = "row_id") -> DataFrame:
    """0-based running id after a global sort, computed in the JVM.

    The sorted (range-partitioned) frame is tagged with its partition id and the position
    inside the partition, and checkpointed so that both stay fixed. Per-partition row counts
    (one row per partition) are prefix-summed into offsets and broadcast back. No task sees
    more than its own partition; nothing goes through Python or the driver.
    """
    from windlass.session import cut_lineage
    tagged = df.orderBy(*order).withColumns({"__p": F.spark_partition_id(),
                                             "__m": F.monotonically_increasing_id()})
    tagged = cut_lineage(tagged)
    counts = tagged.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    # one row per partition: a window without partitioning is bounded by the partition count
    w = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__off", F.coalesce(F.sum("__n").over(w), F.lit(0))).drop("__n")
    local = F.col("__m") - F.shiftleft(F.col("__p").cast("long"), 33)
    return (tagged.join(F.broadcast(offsets), "__p")
            .withColumn(name, (F.col("__off") + local).cast("long"))
            .drop("__p", "__m", "__off"))


def time_folds(df: DataFrame, key: str, order: Sequence[str], max_splits: int = 5,
               min_splits: int = 2, rows_per_split: int = 500) -> DataFrame:
    """Expanding-window folds per key (TimeSeriesSplit layout).

    With n rows, ``k = min(max_splits, max(min_splits, n // rows_per_split))`` folds of
    ``size = n // (k + 1)`` rows: fold i tests rows [n-(k-i)*size, n-(k-i-1)*size) and trains
    on every row before. Output: one row per (row, fold) with ``role`` train/test.
    Rows are numbered by ``sequence_index`` (no window per key): by the first column of ``order``, ties by the second.
    """
    idx = sequence_index(df, key, order[0], name="__i", tie=order[1] if len(order) > 1 else None)
    idx = idx.withColumn("__i", F.col("__i").cast("int"))
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    k = F.least(F.lit(max_splits), F.greatest(F.lit(min_splits), F.floor(F.col("__n") / rows_per_split)))
    counts = counts.withColumn("__k", k.cast("int")).withColumn("__size", F.floor(F.col("__n") / (F.col("__k") + 1)))
    j = idx.join(counts, key)
    folds = j.withColumn("fold", F.explode(F.sequence(F.lit(0), F.col("__k") - 1)))
    test_lo = F.col("__n") - (F.col("__k") - F.col("fold")) * F.col("__size")
    test_hi = F.col("__n") - (F.col("__k") - F.col("fold") - 1) * F.col("__size")
    role = F.when((F.col("__i") >= test_lo) & (F.col("__i") < test_hi), "test") \
            .when(F.col("__i") < test_lo, "train")
    return (folds.withColumn("role", role).filter(F.col("role").isNotNull())
            .withColumnRenamed("__i", "row_index").drop("__n", "__k", "__size"))
