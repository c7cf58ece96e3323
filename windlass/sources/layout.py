"""Station layout on disk (S12, O2): observation tables stored so that station work needs no exchange.

``write_station_layout`` stores a table in (station, day) pieces with their halo (``operators.pieces``), bucketed by
(station, day) and sorted inside the bucket. Lags and rolling windows over the stored table then read a bucket
and run: the plan has neither Exchange nor Sort. A station with most of the rows lies in as many buckets as it has days.

``write_station_buckets`` stores a table bucketed by station alone, for joins and aggregations on the station: two tables written with
one bucket number join without an exchange. Its buckets hold whole stations, so it is for tables without a hot station (dimensions,
daily states); observations belong in the first form.

One write task makes each bucket, so a bucket is one file and its order holds on read (``use_layout_order``).
Each table has a name in the session's catalog and a folder of its own under ``path``, which a later session registers again with
``open_layout``; nothing is kept in a local warehouse.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession

from windlass.operators.pieces import OWN, PIECE, piece_window, tie_column, with_halo
from windlass.operators.sequence import lags_in_pieces

#: Spark keeps the order of a bucket file only if asked to; the layout's files are one a bucket, so it holds.
ORDER_CONF = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def use_layout_order(spark: SparkSession) -> None:
    spark.conf.set(ORDER_CONF, "true")


def _store(df: DataFrame, name: str, path: str, buckets: int, by: Sequence[str], sort: Sequence[str]) -> DataFrame:
    spark = df.sparkSession
    (df.repartition(buckets, *by).write.format("parquet").mode("overwrite").option("path", f"{path}/{name}")
     .bucketBy(buckets, *by).sortBy(*sort).saveAsTable(name))
    use_layout_order(spark)
    return spark.table(name)


def write_station_layout(df: DataFrame, name: str, path: str, buckets: int, cols: Sequence[str], back: int = 5, key: str = "station",
                         order: str = "time", tie: str | None = None, chunk: Column | None = None) -> DataFrame:
    """Store ``df`` with the last ``back`` rows of ``cols`` before each piece; gives the stored table."""
    tie = tie or tie_column(df.columns, key, order)
    pieces = with_halo(df, back, cols, key, order, tie, chunk)
    return _store(pieces, name, path, buckets, [key, PIECE], [key, PIECE, OWN, order, *([tie] if tie else [])])


def write_station_buckets(df: DataFrame, name: str, path: str, buckets: int, key: str = "station", sort: Sequence[str] = ()) -> DataFrame:
    """Store ``df`` bucketed by ``key`` and sorted by it, then by ``sort``."""
    return _store(df, name, path, buckets, [key], [key, *sort])


def open_layout(spark: SparkSession, like: DataFrame, name: str, path: str, buckets: int, by: Sequence[str], sort: Sequence[str]) -> DataFrame:
    """Register a stored table in this session: ``like`` has its columns, the other arguments are those it was written with."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS `{name}` ({columns}) USING parquet LOCATION '{path}/{name}' CLUSTERED BY "
              f"({', '.join(f'`{c}`' for c in by)}) SORTED BY ({', '.join(f'`{c}`' for c in sort)}) INTO {buckets} BUCKETS")
    use_layout_order(spark)
    return spark.table(name)


def layout_lags(stored: DataFrame, columns: Sequence[str], cols: Sequence[str], lags: Sequence[int], key: str = "station",
                order: str = "time", tie: str | None = None) -> DataFrame:
    """Lags over a stored layout; ``columns`` are those of the table that was written. The rows of ``with_lags``."""
    return lags_in_pieces(stored, cols, lags, piece_window(columns, key, order, tie))
