"""Event case studies: nearest station of each event, the observations in a window around
it, stratified samples of events, distinct event sites (SURVEY 2.12: tornado data / map)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windlass.functions.scalar import KMH_TO_MPH, hours_between
from windlass.operators.aggregates import round_doubles
from windlass.operators.sampling import stratified_sample
from windlass.operators.spatial import k_nearest
from windlass.operators.temporal import event_window_join
from windlass.plans.registry import DIGITS, R, hash_sql, haversine_sql, query
from windlass.session import cut_lineage
from windlass.sources import standins as sv


def nearest_stations(places: DataFrame, stations: DataFrame, k: int, place_key: str,
                     lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """The k nearest stations of every place, with distance (km) and rank."""
    p = places.select(place_key, F.col(lat).alias("__lat"), F.col(lon).alias("__lon"))
    res = k_nearest(p, stations, k, place_key=place_key, place_lat="__lat", place_lon="__lon")
    return res.drop("__lat", "__lon")


@query("nearest_stations", "J4 W7", views=("stations", "events_dim"), sql=f"""
SELECT ev, station, {R('dist')} AS distance_km, CAST(rank AS INTEGER) AS rank FROM (
  SELECT ev, station, dist, row_number() OVER (PARTITION BY ev ORDER BY dist, station) AS rank
  FROM (SELECT e.ev, s.station, {haversine_sql('e.start_lat', 'e.start_lon', 's.latitude', 's.longitude')} AS dist
        FROM events_dim e, stations s)
) WHERE rank <= 3
""")
def q_nearest_stations(spark, d):
    ev = sv.events_dim(spark, d)
    return round_doubles(nearest_stations(ev, sv.stations(spark, d), 3, "ev", "start_lat", "start_lon"), DIGITS)


def event_window_wind(events: DataFrame, stations: DataFrame, obs: DataFrame, days: int = 3,
                      factor: float = KMH_TO_MPH, **how) -> DataFrame:
    """Each event's nearest station (k = 1) and its observations from ``days`` before to
    ``days`` after the event date (inclusive); ``time_delta`` = hours from the event's midnight."""
    # the interval join reads the events twice (counts, then rows): the search runs once
    near = cut_lineage(nearest_stations(events, stations, 1, "ev", "start_lat", "start_lon").select("ev", "station"))
    ev = events.select("ev", "magnitude", "d").join(near, "ev")
    j = event_window_join(ev, obs.select("station", "time", "wspd", "wdir"), days=days, **how)
    return j.select(
        "ev", "magnitude", "station", "time",
        hours_between(F.col("d").cast("timestamp_ntz"), F.col("time")).alias("time_delta"),
        "wspd", "wdir", (F.col("wspd") * F.lit(factor)).alias("wspd_mph"),
        F.dayofyear("time").alias("day_of_year"))


_NEAR1_SQL = f"""near AS (
  SELECT ev, magnitude, d, station FROM (
    SELECT e.ev, e.magnitude, e.d, s.station,
      row_number() OVER (PARTITION BY e.ev ORDER BY {haversine_sql('e.start_lat', 'e.start_lon', 's.latitude', 's.longitude')}, s.station) AS rn
    FROM {{src}} e, stations s) WHERE rn = 1)"""

_WINDOW_SELECT_SQL = f"""
SELECT n.ev, n.magnitude, n.station, o.time,
  date_diff('microsecond', CAST(n.d AS TIMESTAMP), o.time) / 3600000000e0 AS time_delta,
  o.wspd, o.wdir, o.wspd * 0.621371e0 AS wspd_mph, CAST(dayofyear(o.time) AS INTEGER) AS day_of_year
FROM near n JOIN obs o ON o.station = n.station
  AND o.time BETWEEN CAST(n.d - 3 AS TIMESTAMP) AND CAST(n.d + 3 AS TIMESTAMP)
"""


@query("event_window_wind", "J4 J5 F4 F8 F2", views=("obs", "stations", "events_dim"),
       sql="WITH " + _NEAR1_SQL.format(src="events_dim") + _WINDOW_SELECT_SQL)
def q_event_window_wind(spark, d):
    # row-level IEEE arithmetic only: identical in both engines, no final rounding needed
    return event_window_wind(sv.events_dim(spark, d), sv.stations(spark, d), sv.obs(spark, d))


_STRATA_SQL = f"""
SELECT ev, station, magnitude, d, start_lat, start_lon FROM events_dim WHERE magnitude = 4
UNION ALL
SELECT ev, station, magnitude, d, start_lat, start_lon FROM (
  SELECT *, row_number() OVER (PARTITION BY magnitude ORDER BY {hash_sql('ev')}, ev) AS rn
  FROM events_dim WHERE magnitude <> 4) WHERE rn <= 5
"""


def case_study_events(events: DataFrame, year: int = 2024, seed: int = 42) -> DataFrame:
    """Events of one year: every magnitude-4 event and five of each lower magnitude."""
    ev = events.filter(F.year("d") == year)
    return stratified_sample(ev, "magnitude", [4], 5, key="ev", seed=seed)


@query("stratified_sample", "X1 P6", views=("events_dim",), sql=_STRATA_SQL)
def q_stratified_sample(spark, d):
    return case_study_events(sv.events_dim(spark, d)).select(
        "ev", "station", "magnitude", "d", "start_lat", "start_lon")


@query("event_case_study", "X1 J4 J5 F4", views=("obs", "stations", "events_dim"),
       sql="WITH strata AS (" + _STRATA_SQL + "), " + _NEAR1_SQL.format(src="strata") + _WINDOW_SELECT_SQL)
def q_event_case_study(spark, d):
    return event_window_wind(case_study_events(sv.events_dim(spark, d)), sv.stations(spark, d), sv.obs(spark, d))


def event_sites(events: DataFrame, stations: DataFrame, obs: DataFrame, days: int = 3) -> DataFrame:
    """Events whose nearest station has an observation in the window of ``event_window_wind``. The observations
    are first reduced to the earliest time of each (station, day): the last day counts at its midnight only."""
    near = nearest_stations(events, stations, 1, "ev", "start_lat", "start_lon").select("ev", "station")
    seen = obs.groupBy("station", F.to_date("time").alias("__day")).agg(F.min("time").alias("__first"))
    ev = (events.select("ev", "magnitude", "d").join(near, "ev")
          .withColumn("__last", F.date_add("d", days).cast("timestamp_ntz"))
          .withColumn("__day", F.explode(F.sequence(F.date_sub("d", days), F.date_add("d", days)))))
    hits = ev.join(seen, ["station", "__day"]).filter(F.col("__first") <= F.col("__last"))
    return hits.select("ev", "magnitude", "station").distinct()


@query("event_distinct_sites", "A22 A16", views=("obs", "stations", "events_dim"),
       sql="WITH " + _NEAR1_SQL.format(src="events_dim") + """
SELECT DISTINCT n.ev, n.magnitude, n.station FROM near n
WHERE EXISTS (SELECT 1 FROM obs o WHERE o.station = n.station
  AND o.time BETWEEN CAST(n.d - 3 AS TIMESTAMP) AND CAST(n.d + 3 AS TIMESTAMP))
""")
def q_event_distinct_sites(spark, d):
    """Distinct event sites that have observations in their window."""
    return event_sites(sv.events_dim(spark, d), sv.stations(spark, d), sv.obs(spark, d))
