"""Climate-normals reports.

Stand-in: ``normals`` (from lineitem) gives month, day of year, four measures in tenths and a
direction code; ``events`` gives the hour of day. One clean view feeds every report.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windlass.functions.scalar import (SEASON_ORDER, compass_label, parse_normals_date, season, tenths,
                                       time_bin)
from windlass.operators.aggregates import (describe, mean_by, min_mean_max, round_doubles, share_within,
                                           value_share)
from windlass.operators.joins import reindex
from windlass.operators.reshape import unpivot
from windlass.operators.sampling import sample_per_group
from windlass.plans.registry import DIGITS, R, hash_sql, query
from windlass.sources import standins as sv

MEASURES = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]


def clean_normals(spark, d) -> DataFrame:
    """Stand-in normals with the measures scaled from tenths (P12) and a season."""
    n = sv.normals(spark, d)
    return n.withColumns({c: tenths(c) for c in MEASURES}).withColumn("season", season("month"))


_CLEAN_SQL = ("clean AS (SELECT *, " + ", ".join(f"{c} / 10e0 AS {c}_s" for c in MEASURES) +
              ", CASE WHEN month IN (12, 1, 2) THEN 'Winter' WHEN month BETWEEN 3 AND 5 THEN 'Spring' "
              "WHEN month BETWEEN 6 AND 8 THEN 'Summer' WHEN month BETWEEN 9 AND 11 THEN 'Fall' END AS season "
              "FROM normals)")

_STATS = [("count", "CAST(count({c}) AS DOUBLE)"), ("mean", "avg({c})"), ("std", "stddev_samp({c})"),
          ("min", "CAST(min({c}) AS DOUBLE)"), ("25%", "quantile_cont({c}, 0.25)"),
          ("50%", "quantile_cont({c}, 0.5)"), ("75%", "quantile_cont({c}, 0.75)"),
          ("max", "CAST(max({c}) AS DOUBLE)")]


@query("normals_describe", "S1 P12 A4 A23", views=("normals",), sql="WITH " + _CLEAN_SQL + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{name}' AS statistic, {i} AS position, " +
    ", ".join(f"{R(fmt.format(c=c + '_s'))} AS {c}" for c in MEASURES) + " FROM clean"
    for i, (name, fmt) in enumerate(_STATS)))
def q_normals_describe(spark, d):
    return describe(clean_normals(spark, d), MEASURES, digits=DIGITS)


@query("normals_monthly_long", "A6 U5", views=("normals",), sql="WITH " + _CLEAN_SQL + ", m AS (SELECT month, " +
       ", ".join(f"avg({c}_s) AS {c}" for c in MEASURES) + " FROM clean WHERE month IS NOT NULL GROUP BY month)\n" +
       "\nUNION ALL\n".join(f"SELECT month, '{c}' AS condition, {R(c)} AS percent FROM m" for c in MEASURES))
def q_normals_monthly_long(spark, d):
    m = mean_by(clean_normals(spark, d), ["month"], MEASURES)
    return round_doubles(unpivot(m, ["month"], MEASURES, "condition", "percent"), DIGITS)


@query("normals_daily_range", "A5 U5", views=("normals",), sql="WITH " + _CLEAN_SQL +
       ", s AS (SELECT day_of_year, min(l_quantity_s) AS min, avg(l_quantity_s) AS mean, max(l_quantity_s) AS max "
       "FROM clean WHERE day_of_year IS NOT NULL GROUP BY day_of_year)\n" +
       "\nUNION ALL\n".join(f"SELECT day_of_year, '{k}' AS temp_type, {R(k)} AS temp FROM s"
                            for k in ("min", "mean", "max")))
def q_normals_daily_range(spark, d):
    s = min_mean_max(clean_normals(spark, d), ["day_of_year"], "l_quantity")
    return round_doubles(unpivot(s, ["day_of_year"], ["min", "mean", "max"], "temp_type", "temp"), DIGITS)


@query("normals_hourly_mean", "A1 F2", sql=f"""
SELECT CAST(hour(ts) AS INTEGER) AS hour, {R('avg(value / 10e0)')} AS avg_wind_speed FROM events GROUP BY hour(ts)
""")
def q_normals_hourly_mean(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet")
    h = ev.select(F.hour("ts").alias("hour"), tenths("value").alias("avg_wind_speed"))
    return round_doubles(mean_by(h, ["hour"], ["avg_wind_speed"]), DIGITS)


_PIVOT_COLS = ["l_quantity", "l_discount", "l_tax"]


@query("normals_month_table", "P7 A13", views=("normals",), sql="WITH " + _CLEAN_SQL + " SELECT month, " +
       ", ".join(f"{R(f'avg({c}_s)')} AS {c}" for c in _PIVOT_COLS) +
       " FROM clean WHERE month IS NOT NULL AND " + " AND ".join(f"{c}_s IS NOT NULL" for c in _PIVOT_COLS) +
       " GROUP BY month")
def q_normals_month_table(spark, d):
    n = clean_normals(spark, d).select("month", *_PIVOT_COLS).dropna()
    return round_doubles(mean_by(n, ["month"], _PIVOT_COLS), DIGITS)


@query("normals_percentile_band", "A6 U6", views=("normals",), sql="WITH " + _CLEAN_SQL +
       ", s AS (SELECT day_of_year, avg(l_quantity_s) AS normal, avg(l_extendedprice_s) AS pctl90 "
       "FROM clean WHERE day_of_year IS NOT NULL GROUP BY day_of_year)\n"
       f"SELECT day_of_year, 'normal' AS metric, {R('normal')} AS value FROM s UNION ALL "
       f"SELECT day_of_year, 'pctl90', {R('pctl90')} FROM s")
def q_normals_percentile_band(spark, d):
    n = clean_normals(spark, d).select("day_of_year", F.col("l_quantity").alias("normal"),
                                       F.col("l_extendedprice").alias("pctl90"))
    s = mean_by(n, ["day_of_year"], ["normal", "pctl90"])
    return round_doubles(unpivot(s, ["day_of_year"], ["normal", "pctl90"], "metric", "value"), DIGITS)


@query("normals_day_sample_bins", "W8 F6 F2", sql=f"""
SELECT event_id, day_of_year, hour, dewpoint, wind,
  CASE WHEN hour >= 0 AND hour < 6 THEN 'Night' WHEN hour >= 6 AND hour < 12 THEN 'Morning'
       WHEN hour >= 12 AND hour < 18 THEN 'Afternoon' WHEN hour >= 18 AND hour < 24 THEN 'Early Morning' END AS time_category
FROM (SELECT event_id, CAST(dayofyear(ts) AS INTEGER) AS day_of_year, CAST(hour(ts) AS INTEGER) AS hour,
        CAST(json_extract_string(props, '$.k') AS INTEGER) / 10e0 AS dewpoint, value / 10e0 AS wind,
        row_number() OVER (PARTITION BY dayofyear(ts) ORDER BY {hash_sql('event_id')}, event_id) AS rn
      FROM events) WHERE rn <= 2
""")
def q_normals_day_sample_bins(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet").select(
        "event_id", F.dayofyear("ts").alias("day_of_year"), F.hour("ts").alias("hour"),
        (F.get_json_object("props", "$.k").cast("int") / F.lit(10e0)).alias("dewpoint"),
        tenths("value").alias("wind"))
    s = sample_per_group(ev, "day_of_year", 2, key="event_id", seed=42)
    return s.withColumn("time_category", time_bin("hour"))


_COMPASS_SQL = ("CASE dir_code WHEN 1 THEN 'N' WHEN 2 THEN 'NE' WHEN 3 THEN 'E' WHEN 4 THEN 'SE' WHEN 5 THEN 'S' "
                "WHEN 6 THEN 'SW' WHEN 7 THEN 'W' WHEN 8 THEN 'NW' END")


@query("direction_frequency", "A9 W6 F7", views=("normals",), sql=f"""
SELECT direction, count, {R('count * 100e0 / sum(count) OVER ()')} AS percentage
FROM (SELECT {_COMPASS_SQL} AS direction, count(*) AS count FROM normals
      WHERE {_COMPASS_SQL} IS NOT NULL GROUP BY 1)
""")
def q_direction_frequency(spark, d):
    n = sv.normals(spark, d).select(compass_label("dir_code").alias("direction"))
    return round_doubles(value_share(n, "direction", "count", "percentage"), DIGITS)


@query("season_direction_share", "A8 W6 F5 F7", views=("normals",), sql=f"""
SELECT season, direction, count, {R('count * 100e0 / sum(count) OVER (PARTITION BY season)')} AS percentage
FROM (SELECT CASE WHEN month IN (12, 1, 2) THEN 'Winter' WHEN month BETWEEN 3 AND 5 THEN 'Spring'
               WHEN month BETWEEN 6 AND 8 THEN 'Summer' WHEN month BETWEEN 9 AND 11 THEN 'Fall' END AS season,
             {_COMPASS_SQL} AS direction, count(*) AS count
      FROM normals WHERE {_COMPASS_SQL} IS NOT NULL AND month BETWEEN 1 AND 12 GROUP BY 1, 2)
""")
def q_season_direction_share(spark, d):
    n = sv.normals(spark, d).select(season("month").alias("season"), compass_label("dir_code").alias("direction"))
    c = n.dropna().groupBy("season", "direction").agg(F.count(F.lit(1)).alias("count"))
    return round_doubles(share_within(c, ["season"], "count", "percentage"), DIGITS)


def _season_order_sql():
    return " UNION ALL ".join(f"SELECT '{s}' AS season, {i} AS position" for i, s in enumerate(SEASON_ORDER))


@query("season_stats", "A7 J10 O4", views=("normals",), sql="WITH " + _CLEAN_SQL + f"""
, ord AS ({_season_order_sql()}),
s AS (SELECT season, avg(l_tax_s) AS mean, stddev_samp(l_tax_s) AS std, min(l_tax_s) AS min, max(l_tax_s) AS max
      FROM clean WHERE season IS NOT NULL GROUP BY season)
SELECT o.season, o.position, {R('s.mean')} AS mean, {R('s.std')} AS std, {R('s.min')} AS min, {R('s.max')} AS max
FROM ord o LEFT JOIN s USING (season)
""")
def q_season_stats(spark, d):
    n = clean_normals(spark, d).filter(F.col("season").isNotNull())
    s = n.groupBy("season").agg(F.avg("l_tax").alias("mean"), F.stddev_samp("l_tax").alias("std"),
                                F.min("l_tax").alias("min"), F.max("l_tax").alias("max"))
    order = spark.createDataFrame([(s_, i) for i, s_ in enumerate(SEASON_ORDER)], "season string, position int")
    return round_doubles(reindex(s, order, "season"), DIGITS)


@query("season_spread_ordered", "F23 A1 J10 O4", views=("normals",), sql="WITH " + _CLEAN_SQL + f"""
, ord AS ({_season_order_sql()}),
s AS (SELECT season, avg(l_quantity_s - l_tax_s) AS spread FROM clean WHERE season IS NOT NULL GROUP BY season)
SELECT o.season, o.position, {R('s.spread')} AS spread FROM ord o LEFT JOIN s USING (season)
""")
def q_season_spread_ordered(spark, d):
    n = clean_normals(spark, d).withColumn("spread", F.col("l_quantity") - F.col("l_tax"))
    s = mean_by(n, ["season"], ["spread"])
    order = spark.createDataFrame([(s_, i) for i, s_ in enumerate(SEASON_ORDER)], "season string, position int")
    return round_doubles(reindex(s, order, "season"), DIGITS)


def _date_text_spark():
    e = F.col("event_id")
    base = F.concat(F.date_format("ts", "MM-dd"), F.lit("T"), F.date_format("ts", "HH:mm:ss"))
    return (F.when(e % 97 == 0, F.concat(F.lit("02-30T"), F.date_format("ts", "HH:mm:ss")))
            .when(e % 89 == 0, F.concat(F.lit("02-29T"), F.date_format("ts", "HH:mm:ss")))
            .when(e % 83 == 0, F.lit("bad-date"))
            .otherwise(base))


@query("parse_coerce", "F1 F2 P7", sql="""
SELECT event_id, t AS date, CAST(month(t) AS INTEGER) AS month, CAST(day(t) AS INTEGER) AS day,
  CAST(dayofyear(t) AS INTEGER) AS day_of_year, CAST(hour(t) AS INTEGER) AS hour
FROM (SELECT event_id, try_strptime('2000-' || (CASE
        WHEN event_id % 97 = 0 THEN '02-30T' || strftime(ts, '%H:%M:%S')
        WHEN event_id % 89 = 0 THEN '02-29T' || strftime(ts, '%H:%M:%S')
        WHEN event_id % 83 = 0 THEN 'bad-date'
        ELSE strftime(ts, '%m-%dT%H:%M:%S') END), '%Y-%m-%dT%H:%M:%S') AS t FROM events)
WHERE t IS NOT NULL
""")
def q_parse_coerce(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet").select("event_id", _date_text_spark().alias("DATE"))
    p = ev.select("event_id", parse_normals_date("DATE").cast("timestamp_ntz").alias("date")).dropna(subset=["date"])
    return p.withColumns({"month": F.month("date"), "day": F.dayofmonth("date"),
                          "day_of_year": F.dayofyear("date"), "hour": F.hour("date")})
