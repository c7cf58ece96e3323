"""Wind reports over observations and stations (SURVEY 2.12: wind profiles, wind tables,
regional daily wind, feature temperature, city-day wind, explorer)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from windlass.functions.circular import circular_mean
from windlass.functions.scalar import (KMH_TO_MPH, SPEED_PALETTE, c_to_f, chart_vector, direction_blend_colour, direction_sector,
                                       palette_mix, round_half_even, scale_position, sector_colour)
from windlass.dims import GEO_FEATURES
from windlass.operators.aggregates import padded_domain, round_doubles, wind_mean, wind_profile
from windlass.operators.joins import maybe_broadcast
from windlass.operators.selection import box_selection, highlight, interval_selection, point_selection
from windlass.operators.temporal import date_spine
from windlass.plans.registry import (DIGITS, R, blend_colour_sql, circ_sql, palette_sql, pmod360_sql, query,
                                     sector_sql)
from windlass.sources import standins as sv


def regional_wind_profile(obs: DataFrame, stations: DataFrame, digits: int | None = 1,
                          approx: bool = False) -> DataFrame:
    """A3 per (region, city): observations joined to their station (J1), profiled, sorted by
    region and falling mean speed (O1, nulls last)."""
    joined = obs.join(stations.select("station", "region", "city"), "station")
    prof = wind_profile(joined, ["region", "city"], approx=approx)
    prof = round_doubles(prof, digits)
    return prof.orderBy(F.col("region").asc_nulls_last(), F.col("avg_wind_speed_kmh").desc_nulls_last(),
                        F.col("city").asc_nulls_last())


@query("regional_wind_profile", "S4 J1 A2 A3 O1", views=("obs", "stations"), sql=f"""
SELECT region, city,
  {R('avg(wspd)')} AS avg_wind_speed_kmh,
  {R('quantile_cont(wspd, 0.95)')} AS wind_speed_95th_kmh,
  {R('max(wspd)')} AS max_wind_speed_kmh,
  {R('stddev_samp(wspd)')} AS wind_speed_std_kmh,
  {R(circ_sql('wdir'))} AS avg_wind_direction_deg
FROM obs JOIN stations USING (station)
GROUP BY region, city
""")
def q_regional_wind_profile(spark: SparkSession, d: str) -> DataFrame:
    return regional_wind_profile(sv.obs(spark, d), sv.stations(spark, d), digits=DIGITS)


# ---- wind tables (sector colour, blended colour) ----------------------------------------------
def wind_table_sector(obs: DataFrame, stations: DataFrame, factor: float = KMH_TO_MPH,
                      digits: int | None = 1, dir_digits: int | None = 0) -> DataFrame:
    """Mean speed (mph) and mean direction per city with the direction's compass sector colour."""
    j = obs.join(stations.select("station", "region", "city"), "station")
    t = j.groupBy("region", "city").agg(
        (F.avg("wspd") * F.lit(factor)).alias("avg_wind_speed_mph"),
        circular_mean("wdir").alias("avg_wind_direction_deg"))
    if digits is not None:
        t = t.withColumn("avg_wind_speed_mph", round_half_even("avg_wind_speed_mph", digits))
    if dir_digits is not None:
        t = t.withColumn("avg_wind_direction_deg", round_half_even("avg_wind_direction_deg", dir_digits))
    t = t.withColumns({"sector": direction_sector("avg_wind_direction_deg"),
                       "sector_colour": sector_colour("avg_wind_direction_deg")})
    return t.orderBy(F.col("region").asc_nulls_last(), F.col("avg_wind_speed_mph").desc_nulls_last(), "city")


@query("wind_table_sector", "A1 A2 F8 F12 O1", views=("obs", "stations"), sql=f"""
SELECT region, city, avg_wind_speed_mph, avg_wind_direction_deg,
  {sector_sql('avg_wind_direction_deg')} AS sector,
  CASE {sector_sql('avg_wind_direction_deg')} WHEN 'N' THEN '#007bff' WHEN 'E' THEN '#dc3545'
    WHEN 'S' THEN '#ffc107' WHEN 'W' THEN '#28a745' ELSE '#ffffff' END AS sector_colour
FROM (
  SELECT region, city, {R('avg(wspd) * 0.621371e0')} AS avg_wind_speed_mph,
    {R(circ_sql('wdir'))} AS avg_wind_direction_deg
  FROM obs JOIN stations USING (station) GROUP BY region, city
)
""")
def q_wind_table_sector(spark, d):
    return wind_table_sector(sv.obs(spark, d), sv.stations(spark, d), digits=DIGITS, dir_digits=DIGITS)


def with_speed_scale(t: DataFrame, speed: str) -> DataFrame:
    """A16 + F14: the speed's domain over the table (one row per place), its position in the domain and its palette colour."""
    whole = Window.partitionBy()  # an aggregated table: a row per place
    t = t.withColumns({"domain_min": F.min(speed).over(whole), "domain_max": F.max(speed).over(whole)})
    t = t.withColumn("speed_position", scale_position(speed, F.col("domain_min"), F.col("domain_max")))
    return t.withColumn("speed_colour", palette_mix("speed_position", SPEED_PALETTE))


def speed_scale_sql(speed: str) -> str:
    lo, hi = f"min({speed}) OVER ()", f"max({speed}) OVER ()"
    pos = f"(({speed} - {lo}) / nullif({hi} - {lo}, 0))"
    return f"{lo} AS domain_min, {hi} AS domain_max, {R(pos)} AS speed_position, {palette_sql(pos, SPEED_PALETTE)} AS speed_colour"


def wind_table_blend(obs: DataFrame, stations: DataFrame, digits: int | None = 1,
                     dir_digits: int | None = 0) -> DataFrame:
    """Mean speed (km/h) and direction per city, blended direction colour (F13) and the
    speed's position on the table's [min, max] colour scale (A16 + F14)."""
    t = wind_mean(obs.join(stations.select("station", "region", "city"), "station"), ["region", "city"])
    if digits is not None:
        t = t.withColumn("avg_wind_speed_kmh", round_half_even("avg_wind_speed_kmh", digits))
    if dir_digits is not None:
        t = t.withColumn("avg_wind_direction_deg", round_half_even("avg_wind_direction_deg", dir_digits))
    out = with_speed_scale(t, "avg_wind_speed_kmh").withColumn("direction_colour", direction_blend_colour("avg_wind_direction_deg"))
    return out.orderBy(F.col("region").asc_nulls_last(), F.col("avg_wind_speed_kmh").desc_nulls_last(), "city")


@query("wind_table_blend", "A1 A2 F13 F14 A16 O1", views=("obs", "stations"), sql=f"""
SELECT region, city, avg_wind_speed_kmh, avg_wind_direction_deg,
  {blend_colour_sql('avg_wind_direction_deg')} AS direction_colour,
  {speed_scale_sql('avg_wind_speed_kmh')}
FROM (
  SELECT region, city, {R('avg(wspd)')} AS avg_wind_speed_kmh, {R(circ_sql('wdir'))} AS avg_wind_direction_deg
  FROM obs JOIN stations USING (station) GROUP BY region, city
)
""")
def q_wind_table_blend(spark, d):
    return round_doubles(wind_table_blend(sv.obs(spark, d), sv.stations(spark, d), DIGITS, DIGITS), DIGITS)


# ---- regional daily wind (daily means, spine for places without data) ----------------------------
def cities_of_nations(spark: SparkSession, d: str) -> DataFrame:
    """Stand-in place dimension: every nation is a city; its stations are those with station % 25 = key."""
    n = spark.read.parquet(f"{d}/nation.parquet")
    r = spark.read.parquet(f"{d}/region.parquet")
    return n.join(r, r.r_regionkey == n.n_regionkey).select(
        F.col("r_name").alias("region"), F.col("n_name").alias("city"), F.col("n_nationkey").alias("city_key"))


def regional_daily_wind(obs: DataFrame, places: DataFrame, start: str, end: str,
                        factor: float = KMH_TO_MPH) -> DataFrame:
    """Daily mean speed (mph) per place; places with no data at all get a spine of null days
    (J9); then the mean over the places of each region per day."""
    day = F.to_date("time")
    o = obs.filter(day.between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    j = o.join(places, places.city_key == F.col("station") % 25)
    daily = j.groupBy("region", "city", day.alias("date")).agg(
        (F.avg("wspd") * F.lit(factor)).alias("wspd_mph"))
    spine = date_spine(places, daily, ["region", "city"], start, end, {"wspd_mph": "double"})
    allp = daily.unionByName(spine)
    return allp.groupBy("date", "region").agg(F.avg("wspd_mph").alias("wspd_mph"))


_CITIES_SQL = "cities AS (SELECT r_name AS region, n_name AS city, n_nationkey AS city_key FROM nation JOIN region ON r_regionkey = n_regionkey)"


@query("regional_daily_wind", "S5 F2 F8 A1 J9 U1", views=("obs",), sql=f"""
WITH {_CITIES_SQL},
daily AS (
  SELECT c.region, c.city, CAST(o.time AS DATE) AS date, avg(o.wspd) * 0.621371e0 AS wspd_mph
  FROM obs o JOIN cities c ON c.city_key = o.station % 25
  WHERE CAST(o.time AS DATE) BETWEEN date '2024-01-01' AND date '2024-01-30'
  GROUP BY c.region, c.city, CAST(o.time AS DATE)
),
spine AS (
  SELECT c.region, c.city, CAST(unnest(generate_series(date '2024-01-01', date '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS date,
    CAST(NULL AS DOUBLE) AS wspd_mph
  FROM cities c WHERE NOT EXISTS (SELECT 1 FROM daily x WHERE x.region = c.region AND x.city = c.city)
)
SELECT date, region, {R('avg(wspd_mph)')} AS wspd_mph
FROM (SELECT * FROM daily UNION ALL SELECT * FROM spine) GROUP BY date, region
""")
def q_regional_daily_wind(spark, d):
    return round_doubles(regional_daily_wind(sv.obs(spark, d), cities_of_nations(spark, d),
                                             "2024-01-01", "2024-01-30"), DIGITS)


# ---- geographic-feature temperature (two-stage mean, J3 default feature) -------------------------
def feature_dim(spark: SparkSession, d: str) -> DataFrame:
    """Stand-in feature dimension derived from the nation table: nation key % 7 picks one of the
    six features; key % 7 = 6 has no entry, so those cities default to 'Standard' (J3)."""
    n = spark.read.parquet(f"{d}/nation.parquet")
    feats = F.array(*[F.lit(x) for x in GEO_FEATURES[:6]])
    return n.filter(F.col("n_nationkey") % 7 < 6).select(
        F.col("n_name").alias("city"), F.element_at(feats, (F.col("n_nationkey") % 7 + 1).cast("int")).alias("feature"))


def feature_daily_temperature(obs: DataFrame, places: DataFrame, features: DataFrame,
                              start: str, end: str) -> DataFrame:
    """Hourly temperature in F -> daily mean per city -> mean per (date, feature) (A10)."""
    pf = with_default_feature(places, features)
    day = F.to_date("time")
    o = obs.filter(day.between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    j = o.join(pf, pf.city_key == F.col("station") % 25)
    daily = j.groupBy("feature", "city", day.alias("date")).agg(F.avg(c_to_f("temp")).alias("temp_f"))
    spine = date_spine(pf, daily, ["feature", "city"], start, end, {"temp_f": "double"})
    return daily.unionByName(spine).groupBy("date", "feature").agg(F.avg("temp_f").alias("temp_f"))


def with_default_feature(places: DataFrame, features: DataFrame, default: str = "Standard") -> DataFrame:
    """Left join to a small feature dimension; places without an entry get ``default``."""
    return places.join(maybe_broadcast(features), "city", "left").withColumn(
        "feature", F.coalesce(F.col("feature"), F.lit(default)))


_FEATURES_SQL = ("features AS (SELECT n_name AS city, "
                 "list_extract(['" + "','".join(GEO_FEATURES[:6]) + "'], CAST(n_nationkey % 7 + 1 AS INTEGER)) AS feature "
                 "FROM nation WHERE n_nationkey % 7 < 6)")


@query("feature_daily_temperature", "S3 F8 A10 J3 J9", views=("obs",), sql=f"""
WITH {_CITIES_SQL}, {_FEATURES_SQL},
pf AS (SELECT c.*, coalesce(f.feature, 'Standard') AS feature FROM cities c LEFT JOIN features f USING (city)),
daily AS (
  SELECT p.feature, p.city, CAST(o.time AS DATE) AS date, avg(o.temp * 9 / 5 + 32) AS temp_f
  FROM obs o JOIN pf p ON p.city_key = o.station % 25
  WHERE CAST(o.time AS DATE) BETWEEN date '2024-01-01' AND date '2024-01-30'
  GROUP BY p.feature, p.city, CAST(o.time AS DATE)
),
spine AS (
  SELECT p.feature, p.city, CAST(unnest(generate_series(date '2024-01-01', date '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS date,
    CAST(NULL AS DOUBLE) AS temp_f
  FROM pf p WHERE NOT EXISTS (SELECT 1 FROM daily x WHERE x.feature = p.feature AND x.city = p.city)
)
SELECT date, feature, {R('avg(temp_f)')} AS temp_f
FROM (SELECT * FROM daily UNION ALL SELECT * FROM spine) GROUP BY date, feature
""")
def q_feature_daily_temperature(spark, d):
    return round_doubles(feature_daily_temperature(sv.obs(spark, d), cities_of_nations(spark, d),
                                                   feature_dim(spark, d), "2024-01-01", "2024-01-30"), DIGITS)


# ---- city x day-of-year wind with the chart's y domain --------------------------------------------
def city_day_wind(obs: DataFrame, stations: DataFrame, factor: float = KMH_TO_MPH) -> DataFrame:
    """Mean speed per (city, day of year) in mph; ``y_domain_max`` = overall max + 2."""
    j = obs.join(stations.select("station", "city"), "station")
    t = j.groupBy("city", F.dayofyear("time").alias("day_of_year")).agg(
        (F.avg("wspd") * F.lit(factor)).alias("wind_speed"))
    return t.withColumn("y_domain_max", F.max("wind_speed").over(Window.partitionBy()) + 2)  # an aggregated table


@query("city_day_wind", "A1 F2 F8 A16", views=("obs", "stations"), sql=f"""
SELECT city, day_of_year, {R('wind_speed')} AS wind_speed, {R('max(wind_speed) OVER () + 2')} AS y_domain_max
FROM (SELECT city, CAST(dayofyear(time) AS INTEGER) AS day_of_year, avg(wspd) * 0.621371e0 AS wind_speed
      FROM obs JOIN stations USING (station) GROUP BY city, dayofyear(time))
""")
def q_city_day_wind(spark, d):
    return round_doubles(city_day_wind(sv.obs(spark, d), sv.stations(spark, d)), DIGITS)


# ---- explorer: profile + feature + chart vectors; selections ------------------------------------
def explorer_vectors(obs: DataFrame, stations: DataFrame, features: DataFrame) -> DataFrame:
    """Per-city profile (A3) with its geographic feature (J3) and chart vectors."""
    prof = wind_profile(obs.join(stations.select("station", "region", "city"), "station"), ["region", "city"])
    prof = prof.join(maybe_broadcast(features), "city", "left").withColumn(
        "geographic_feature", F.coalesce("feature", F.lit("Standard"))).drop("feature")
    return prof.withColumns(chart_vector("avg_wind_speed_kmh", "avg_wind_direction_deg"))


def _vector_sql(speed: str, direction: str) -> str:
    r = f"radians({pmod360_sql(direction + ' - 90')})"
    dx, dy = f"(-{speed} * cos({r}))", f"({speed} * sin({r}))"
    k = "2.6179938779914944e0"  # 5*pi/6
    return ", ".join([
        f"{R(dx)} AS dx", f"{R(dy)} AS dy",
        f"{R(f'{dx} - 0.8e0 * cos({r} + {k})')} AS arrow1_end_x",
        f"{R(f'{dy} + 0.8e0 * sin({r} + {k})')} AS arrow1_end_y",
        f"{R(f'{dx} - 0.8e0 * cos({r} - {k})')} AS arrow2_end_x",
        f"{R(f'{dy} + 0.8e0 * sin({r} - {k})')} AS arrow2_end_y",
    ])


@query("explorer_vectors", "A3 J3 F21", views=("obs", "stations"), sql=f"""
WITH {_FEATURES_SQL},
prof AS (
  SELECT region, city, avg(wspd) AS avg_wind_speed_kmh, quantile_cont(wspd, 0.95) AS wind_speed_95th_kmh,
    max(wspd) AS max_wind_speed_kmh, stddev_samp(wspd) AS wind_speed_std_kmh,
    {circ_sql('wdir')} AS avg_wind_direction_deg
  FROM obs JOIN stations USING (station) GROUP BY region, city
)
SELECT p.region, p.city, {R('p.avg_wind_speed_kmh')} AS avg_wind_speed_kmh,
  {R('p.wind_speed_95th_kmh')} AS wind_speed_95th_kmh, {R('p.max_wind_speed_kmh')} AS max_wind_speed_kmh,
  {R('p.wind_speed_std_kmh')} AS wind_speed_std_kmh, {R('p.avg_wind_direction_deg')} AS avg_wind_direction_deg,
  coalesce(f.feature, 'Standard') AS geographic_feature,
  {_vector_sql('p.avg_wind_speed_kmh', 'p.avg_wind_direction_deg')}
FROM prof p LEFT JOIN features f USING (city)
""")
def q_explorer_vectors(spark, d):
    return round_doubles(explorer_vectors(sv.obs(spark, d), sv.stations(spark, d), feature_dim(spark, d)), DIGITS)


EXPLORER_REGIONS = ["AMERICA", "EUROPE"]
EXPLORER_SPEED = (8.0, 11.0)
EXPLORER_BOX = ((-110.0, -80.0), (30.0, 45.0))


def explorer_selection(obs: DataFrame, stations: DataFrame, regions, speed_range, box) -> DataFrame:
    """Per-station profile with the selections as a highlight flag (P13 point, P14 interval,
    P15 box, combined as in the explorer; P16 flags instead of filtering)."""
    prof = wind_mean(obs, ["station"]).join(stations, "station")
    cond = point_selection("region", regions) & interval_selection("avg_wind_speed_kmh", *speed_range) \
        & box_selection("longitude", "latitude", *box)
    return highlight(prof, cond, "selected")


@query("explorer_selection", "P13 P14 P15 P16", views=("obs", "stations"), sql=f"""
SELECT p.station, s.region, s.city, s.latitude, s.longitude, s.elevation,
  {R('p.avg_wind_speed_kmh')} AS avg_wind_speed_kmh, {R('p.avg_wind_direction_deg')} AS avg_wind_direction_deg,
  coalesce(s.region IN ('AMERICA', 'EUROPE') AND p.avg_wind_speed_kmh BETWEEN 8.0e0 AND 11.0e0
    AND s.longitude BETWEEN -110.0e0 AND -80.0e0 AND s.latitude BETWEEN 30.0e0 AND 45.0e0, false) AS selected
FROM (SELECT station, avg(wspd) AS avg_wind_speed_kmh, {circ_sql('wdir')} AS avg_wind_direction_deg
      FROM obs GROUP BY station) p JOIN stations s USING (station)
""")
def q_explorer_selection(spark, d):
    return round_doubles(explorer_selection(sv.obs(spark, d), sv.stations(spark, d), EXPLORER_REGIONS,
                                            EXPLORER_SPEED, EXPLORER_BOX), DIGITS)
