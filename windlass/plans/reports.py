"""Public report functions over any observation table, station table and place
dimension (e.g. ``dims.places(spark)``).

Every place is matched to its nearest station with the exact grid k-nearest join, and the
observation table is read once for all places: one query instead of one fetch per city.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windlass.functions.circular import circular_mean
from windlass.functions.scalar import (KMH_TO_MPH, MS_TO_MPH, c_to_f, chart_vector, direction_blend_colour,
                                       direction_sector, sector_colour)
from windlass.functions.scalar import round_half_even
from windlass.operators.aggregates import padded_domain, round_doubles, wind_profile
from windlass.operators.sampling import stratified_sample
from windlass.operators.joins import maybe_broadcast
from windlass.operators.spatial import k_nearest
from windlass.operators.temporal import date_spine, event_window_join
from windlass.plans.registry import R, circ_sql, haversine_sql, query
from windlass.plans.wind import with_speed_scale
from windlass.sources import standins as sv


def _obs_of_places(obs: DataFrame, stations: DataFrame, places: DataFrame, start: str, end: str,
                   key: str = "city", whole_days: bool = False) -> DataFrame:
    """S3: observations in [start, end] of each place's nearest station (rank 1). The ends are times, or with
    ``whole_days`` dates, the last one included whole (S5)."""
    near = k_nearest(places, stations, 1, place_key=key).select(*places.columns, "station")
    first, last = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    if whole_days:
        after = F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz")
        o = obs.filter((F.col("time") >= first) & (F.col("time") < after))
    else:
        o = obs.filter(F.col("time").between(first, last))
    return near.join(o, "station")


def wind_stats(obs, stations, places, start="2020-01-01", end="2024-12-31", key="city") -> DataFrame:
    """Mean speed and circular mean direction per place; a place without data keeps a row of
    nulls (S11). ``end`` is inclusive, as a timestamp (so ``2024-12-31`` means its midnight)."""
    o = _obs_of_places(obs, stations, places, start, end, key)
    stats = o.groupBy(key).agg(F.avg("wspd").alias("avg_wind_speed_kmh"),
                               circular_mean("wdir").alias("avg_wind_direction_deg"))
    return places.join(stats, key, "left")


def split_tables(df: DataFrame, groups: Sequence[Sequence[str]], col: str = "region") -> list[DataFrame]:
    """One table per group of regions (two filters over the same plan)."""
    return [df.filter(F.col(col).isin(list(g))) for g in groups]


def wind_tables(obs, stations, places, start="2020-01-01", end="2024-12-31",
                groups=(("Midwest", "Northeast"), ("Southeast", "West"))) -> list[DataFrame]:
    """Speed rounded to 1, direction to 0 decimals, blended direction colour, sorted by region
    and falling speed, split into two tables by region group."""
    t = wind_stats(obs, stations, places, start, end)
    t = t.withColumns({"avg_wind_speed_kmh": round_half_even("avg_wind_speed_kmh", 1),
                       "avg_wind_direction_deg": round_half_even(F.pmod("avg_wind_direction_deg", F.lit(360.0)), 0)})
    t = t.withColumn("direction_colour", direction_blend_colour("avg_wind_direction_deg")).orderBy(
        F.col("region").asc_nulls_last(), F.col("avg_wind_speed_kmh").desc_nulls_last())
    return split_tables(t, groups)


def wind_table(obs, stations, places, start="2024-01-01", end="2024-12-31", factor: float = KMH_TO_MPH) -> DataFrame:
    """Speed in mph (the factor is a parameter; ``MS_TO_MPH`` reproduces the m/s reading), direction, compass-sector colour,
    and the speed's domain, position and palette colour."""
    t = wind_stats(obs, stations, places, start, end)
    t = t.withColumns({"avg_wind_speed_mph": round_half_even(F.col("avg_wind_speed_kmh") * F.lit(factor), 1),
                       "avg_wind_direction_deg": round_half_even("avg_wind_direction_deg", 0)}).drop("avg_wind_speed_kmh")
    t = t.withColumns({"sector": direction_sector("avg_wind_direction_deg"),
                       "sector_colour": sector_colour("avg_wind_direction_deg")})
    t = with_speed_scale(t, "avg_wind_speed_mph")
    return t.orderBy(F.col("region").asc_nulls_last(), F.col("avg_wind_speed_mph").desc_nulls_last())


def hourly_wind(obs, stations, places, start, end, key="city") -> DataFrame:
    """S3 + U1: hourly speed and direction of every place's nearest station."""
    return _obs_of_places(obs, stations, places, start, end, key).select(key, "time", "wspd", "wdir")


def cities_map_data(hourly: DataFrame, key="city", factor: float = KMH_TO_MPH) -> tuple[DataFrame, float]:
    """Mean speed (mph) per (place, day of year) and the chart's y-domain top (max + 2)."""
    d = hourly.groupBy(key, F.dayofyear("time").alias("day_of_year")).agg(
        (F.avg("wspd") * F.lit(factor)).alias("wind_speed"))
    return d, padded_domain(d, "wind_speed", "plus2")[1]


def regional_daily_wind(obs, stations, places, start="2024-01-01", end="2024-12-31",
                        factor: float = KMH_TO_MPH) -> DataFrame:
    """Daily mean speed (mph) per place; places without data get a null spine (J9); mean per
    (date, region)."""
    o = _obs_of_places(obs, stations, places, start, end, whole_days=True)
    daily = o.groupBy("region", "city", F.to_date("time").alias("date")).agg(
        (F.avg("wspd") * F.lit(factor)).alias("wspd_mph"))
    spine = date_spine(places, daily, ["region", "city"], start, end, {"wspd_mph": "double"})
    return daily.unionByName(spine).groupBy("date", F.col("region").alias("Region")).agg(
        F.avg("wspd_mph").alias("wspd_mph"))


def geo_feature_temperature(obs, stations, feature_places, start="2024-01-01", end="2024-12-31") -> DataFrame:
    """Daily mean temperature (F) per feature place; null spine for features without data."""
    o = _obs_of_places(obs, stations, feature_places, start, end, key="feature", whole_days=True)
    daily = o.groupBy("feature", F.to_date("time").alias("date")).agg(F.avg(c_to_f("temp")).alias("temp_f"))
    spine = date_spine(feature_places, daily, ["feature"], start, end, {"temp_f": "double"})
    return daily.unionByName(spine).groupBy("date", F.col("feature").alias("Feature")).agg(
        F.avg("temp_f").alias("temp_f"))


def tornado_data(tracks: DataFrame, stations: DataFrame, obs: DataFrame, year: int = 2024, days: int = 3,
                 seed: int = 42) -> DataFrame:
    """Every magnitude-4 track of the year and five of each lower magnitude (X1); the hourly
    wind of the station nearest each start point within +-days of the event date (J5)."""
    t = tracks.filter(F.col("Year") == year).filter(F.col("event_date").isNotNull())
    t = stratified_sample(t, "Magnitude", [4], 5, key="Tornado Number", seed=seed)
    ev = t.select(F.col("Tornado Number").alias("tornado_number"), F.col("State Abbreviation").alias("state"),
                  F.col("Magnitude").alias("magnitude"), F.col("Starting Latitude").alias("lat"),
                  F.col("Starting Longitude").alias("lon"), F.col("event_date").alias("d"))
    # k_nearest keeps the track's columns: joining back on a number that repeats would multiply rows
    near = k_nearest(ev, stations, 1, place_key="tornado_number", place_lat="lat", place_lon="lon").select(*ev.columns, "station")
    j = event_window_join(near, obs.select("station", "time", "wspd", "wdir"), days)
    return j.select("tornado_number", "state", "magnitude", "lat", "lon", "time",
                    ((F.unix_micros(F.col("time").cast("timestamp")) -
                      F.unix_micros(F.col("d").cast("timestamp"))) / F.lit(3600000000e0)).alias("time_delta"),
                    "wspd", "wdir", F.dayofyear("time").alias("day_of_year"))


def tornado_map_data(tornado_wind: DataFrame, factor: float = KMH_TO_MPH) -> tuple[DataFrame, DataFrame]:
    """Distinct tornados (A22) and the hourly wind in mph (F8)."""
    sites = tornado_wind.select("tornado_number", "state", "magnitude", "lat", "lon").dropDuplicates()
    hourly = tornado_wind.withColumn("wspd_mph", F.col("wspd") * F.lit(factor))
    return sites, hourly


def dashboard_std_data(obs, stations, places, features, start="2024-01-01", end="2024-12-31") -> DataFrame:
    """Per place: mean, 95th percentile, max and std of speed, circular mean direction (A3),
    geographic feature with 'Standard' as default (J3) and the chart vectors (F21)."""
    o = _obs_of_places(obs, stations, places, start, end)
    prof = places.join(wind_profile(o, ["city"]), "city", "left")
    prof = prof.join(maybe_broadcast(features), "city", "left").withColumn(
        "geographic_feature", F.coalesce("feature", F.lit("Standard"))).drop("feature")
    return prof.withColumns(chart_vector("avg_wind_speed_kmh", "avg_wind_direction_deg"))


# ---- registered: wind statistics of placed cities via their nearest station ----------------------------
_NEAR_SQL = f"""
WITH pl AS (SELECT n_nationkey AS place, n_name AS city, 25 + (n_nationkey * 7 % 240) / 10e0 + 0.05e0 AS latitude,
              -120 + (n_nationkey * 13 % 450) / 10e0 + 0.05e0 AS longitude FROM nation),
near AS (SELECT place, station FROM (SELECT pl.place, s.station, row_number() OVER (PARTITION BY pl.place
           ORDER BY {haversine_sql('pl.latitude', 'pl.longitude', 's.latitude', 's.longitude')}, s.station) AS rn
         FROM pl, stations s) WHERE rn = 1),
"""


def _places(spark, d) -> DataFrame:
    """Place dimension of the registered reports: one per nation, beside the stations."""
    n = spark.read.parquet(f"{d}/nation.parquet")
    k = F.col("n_nationkey")
    return n.select(k.alias("place"), F.col("n_name").alias("city"),
                    (F.lit(25) + (k * 7 % 240) / F.lit(10e0) + F.lit(0.05)).alias("latitude"),
                    (F.lit(-120) + (k * 13 % 450) / F.lit(10e0) + F.lit(0.05)).alias("longitude"))


@query("place_wind_stats", "S3 S11 J4 A1 A2", views=("obs", "stations"), sql=_NEAR_SQL + f"""o AS (SELECT near.place, obs.wspd, obs.wdir FROM near JOIN obs USING (station)
      WHERE obs.time BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00'),
st AS (SELECT place, avg(wspd) AS w, {circ_sql('wdir')} AS d FROM o GROUP BY place)
SELECT pl.place, pl.city, {R('pl.latitude')} AS latitude, {R('pl.longitude')} AS longitude,
  {R('st.w')} AS avg_wind_speed_kmh, {R('st.d')} AS avg_wind_direction_deg
FROM pl LEFT JOIN st USING (place)
""")
def q_place_wind_stats(spark, d):
    out = wind_stats(sv.obs(spark, d), sv.stations(spark, d), _places(spark, d), "2024-01-01 00:00:00",
                     "2024-01-20 00:00:00", key="place")
    return round_doubles(out, 6)


@query("place_hourly_wind", "S3 S4 U1 J4", views=("obs", "stations"), sql=_NEAR_SQL + """
o AS (SELECT near.place, obs.time, obs.wspd, obs.wdir FROM near JOIN obs USING (station)
      WHERE obs.time BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00')
SELECT place, time, wspd, wdir FROM o
""")
def q_place_hourly_wind(spark, d):
    return hourly_wind(sv.obs(spark, d), sv.stations(spark, d), _places(spark, d), "2024-01-01 00:00:00", "2024-01-20 00:00:00", key="place")


@query("cities_map_daily", "S3 A1 A16 F2 F8", views=("obs", "stations"), sql=_NEAR_SQL + f"""
o AS (SELECT near.place, obs.time, obs.wspd FROM near JOIN obs USING (station)
      WHERE obs.time BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00'),
m AS (SELECT place, CAST(dayofyear(time) AS INTEGER) AS day_of_year, avg(wspd) * {KMH_TO_MPH!r}e0 AS wind_speed
      FROM o GROUP BY 1, 2)
SELECT place, day_of_year, {R('wind_speed')} AS wind_speed, {R('max(wind_speed) OVER () + 2')} AS domain_top FROM m
""")
def q_cities_map_daily(spark, d):
    daily, top = cities_map_data(q_place_hourly_wind(spark, d), key="place")
    return round_doubles(daily.withColumn("domain_top", F.lit(top).cast("double")), 6)


@query("place_daily_temperature", "S5 A10 F8 J9", views=("obs", "stations"), sql=_NEAR_SQL + f"""
daily AS (SELECT city, CAST(time AS DATE) AS date, avg(temp * 9e0 / 5e0 + 32e0) AS temp_f
          FROM near JOIN pl USING (place) JOIN obs USING (station)
          WHERE time >= TIMESTAMP '2024-01-01' AND time < TIMESTAMP '2024-01-21' GROUP BY 1, 2),
spine AS (SELECT city, CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-20', INTERVAL 1 DAY)) AS DATE) AS date
          FROM pl WHERE city NOT IN (SELECT city FROM daily))
SELECT date, city AS "Feature", {R('temp_f')} AS temp_f FROM daily UNION ALL SELECT date, city, NULL FROM spine
""")
def q_place_daily_temperature(spark, d):
    places = _places(spark, d).select(F.col("city").alias("feature"), "latitude", "longitude")
    return round_doubles(geo_feature_temperature(sv.obs(spark, d), sv.stations(spark, d), places, "2024-01-01", "2024-01-20"), 6)


__all__ = ["wind_stats", "wind_tables", "wind_table", "hourly_wind", "cities_map_data", "regional_daily_wind",
           "geo_feature_temperature", "tornado_data", "tornado_map_data", "dashboard_std_data", "split_tables",
           "MS_TO_MPH"]
