"""Reports read from the stored daily state (``operators.daily_state``): the results of the reports over all observations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windlass.functions.scalar import KMH_TO_MPH
from windlass.operators import daily_state as ds
from windlass.operators.aggregates import padded_domain, round_doubles
from windlass.operators.joins import maybe_broadcast
from windlass.operators.temporal import date_spine
from windlass.plans.registry import DIGITS, QUERIES, R, circ_sql, query
from windlass.plans.wind import cities_of_nations
from windlass.sources import standins as sv
from windlass.sources.files import scratch_path

RANGE = ("2024-01-05", "2024-01-24")


def stored_state(spark, d: str, start: str | None = None, end: str | None = None, sketches=()) -> DataFrame:
    """The daily state of the observations, written to the shared folder and read for a range of days."""
    path = scratch_path(spark, f"daily_state-{uuid.uuid4().hex}")
    ds.write_daily_state(ds.daily_state(sv.obs(spark, d), ["wspd", "temp"], sketches=sketches), path)
    return ds.read_daily_state(spark, path, start, end)


def state_profile(state: DataFrame, stations: DataFrame) -> DataFrame:
    """Mean, extremes and deviation of speed, circular mean direction, per (region, city)."""
    m = ds.merge(state.join(maybe_broadcast(stations.select("station", "region", "city")), "station"), ["region", "city"])
    return m.select("region", "city", ds.mean_of_state("wspd").alias("avg_wind_speed_kmh"), F.col("wspd_min").alias("min_wind_speed_kmh"),
                    F.col("wspd_max").alias("max_wind_speed_kmh"), ds.std_of_state("wspd").alias("wind_speed_std_kmh"),
                    ds.direction_of_state("wdir").alias("avg_wind_direction_deg"), ds.mean_of_state("temp").alias("avg_temp_c"))


@query("state_wind_profile", "S5 A1 A2 A5 A7 (2.12)", views=("obs", "stations"), sql=f"""
SELECT region, city, {R('avg(wspd)')} AS avg_wind_speed_kmh, {R('min(wspd)')} AS min_wind_speed_kmh, {R('max(wspd)')} AS max_wind_speed_kmh,
  {R('stddev_samp(wspd)')} AS wind_speed_std_kmh, {R(circ_sql('wdir'))} AS avg_wind_direction_deg, {R('avg(temp)')} AS avg_temp_c
FROM obs JOIN stations USING (station)
WHERE CAST(time AS DATE) BETWEEN date '{RANGE[0]}' AND date '{RANGE[1]}' GROUP BY region, city
""")
def q_state_wind_profile(spark, d):
    return round_doubles(state_profile(stored_state(spark, d, *RANGE), sv.stations(spark, d)), DIGITS)


def state_regional_daily_wind(state: DataFrame, places: DataFrame, start: str, end: str, factor: float = KMH_TO_MPH) -> DataFrame:
    """``wind.regional_daily_wind`` from the state: daily mean per place, null days for places without any, mean per region."""
    m = ds.merge(state.join(maybe_broadcast(places), F.col("city_key") == F.col("station") % 25), ["region", "city", "date"])
    daily = m.select("region", "city", "date", (ds.mean_of_state("wspd") * F.lit(factor)).alias("wspd_mph"))
    spine = date_spine(places, daily, ["region", "city"], start, end, {"wspd_mph": "double"})
    return daily.unionByName(spine).groupBy("date", "region").agg(F.avg("wspd_mph").alias("wspd_mph"))


@query("state_regional_daily_wind", "S5 J9 A10 (2.12)")
def q_state_regional_daily_wind(spark, d):
    days = ("2024-01-01", "2024-01-30")
    return round_doubles(state_regional_daily_wind(stored_state(spark, d, *days), cities_of_nations(spark, d), *days), DIGITS)


def state_city_day_wind(state: DataFrame, stations: DataFrame, factor: float = KMH_TO_MPH) -> DataFrame:
    """``wind.city_day_wind`` from the state."""
    m = ds.merge(state.join(maybe_broadcast(stations.select("station", "city")), "station"), ["city", F.dayofyear("date").alias("day_of_year")])
    t = m.select("city", "day_of_year", (ds.mean_of_state("wspd") * F.lit(factor)).alias("wind_speed"))
    _, top = padded_domain(t, "wind_speed", mode="plus2")
    return t.withColumn("y_domain_max", F.lit(top).cast("double"))


@query("state_city_day_wind", "A1 A16 (2.12)")
def q_state_city_day_wind(spark, d):
    return round_doubles(state_city_day_wind(stored_state(spark, d), sv.stations(spark, d)), DIGITS)


# the same results as the reports over all observations, so the same SQL
for _name in ("regional_daily_wind", "city_day_wind"):
    QUERIES[f"state_{_name}"].sql = QUERIES[_name].sql


@query("state_speed_quantiles", "A3 A15 (approximate)")
def q_state_speed_quantiles(spark, d):
    """Approximate quartiles and 95th percentile of speed per city, from the days' merged KLL sketches."""
    m = ds.merge(stored_state(spark, d, sketches=["wspd"]).join(sv.stations(spark, d).select("station", "city"), "station"), ["city"])
    q = ds.quantiles_of_state("wspd", [0.25, 0.5, 0.75, 0.95])
    return m.select("city", "wspd_n", *[q[i].alias(n) for i, n in enumerate(("q25", "q50", "q75", "q95"))])
