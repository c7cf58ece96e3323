"""Observation sources re-aimed at tables.

The reference fetches one place at a time from a web service. Here every place is served
by one query: places are matched to their nearest stations (J4) and the observation table
is joined once, with the time range as a scan filter (pushed to Parquet / partitions).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windlass.operators.spatial import k_nearest


def _in_range(col: str, start: str, end: str):
    return F.col(col).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))


def observations_near(obs: DataFrame, stations: DataFrame, places: DataFrame, start: str, end: str,
                      place_key: str = "city", k: int = 1) -> DataFrame:
    """S3: observations in [start, end] (both inclusive) of each place's nearest station(s)."""
    near = k_nearest(places, stations, k, place_key=place_key)
    o = obs.filter(_in_range("time", start, end))
    return near.join(o, "station")


def observations_of(obs: DataFrame, station_ids: DataFrame, start: str, end: str) -> DataFrame:
    """Observations of a list of stations (semi join) in [start, end]."""
    return obs.filter(_in_range("time", start, end)).join(station_ids.select("station"), "station", "left_semi")


def daily_from_hourly(obs: DataFrame, cols=("wspd",)) -> DataFrame:
    """Daily means per station from hourly rows."""
    return obs.groupBy("station", F.to_date("time").alias("date")).agg(*[F.avg(c).alias(c) for c in cols])


def stations_nearby(stations: DataFrame, places: DataFrame, n: int, place_key: str = "place",
                    country: str | None = None) -> DataFrame:
    """The ``n`` nearest stations of each place, optionally of one country only."""
    st = stations if country is None else stations.filter(F.col("country") == country)
    return k_nearest(places, st, n, place_key=place_key)


def with_null_rows(places: DataFrame, stats: DataFrame, key: str, keep_missing: bool = True) -> DataFrame:
    """A place without data keeps one row of nulls (left join) or is skipped (inner)."""
    return places.join(stats, key, "left" if keep_missing else "inner")
