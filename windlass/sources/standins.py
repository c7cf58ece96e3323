"""Stand-in views over the given test tables.

The library works on observation, station, event and normals tables. The test data holds
TPC-H-style tables plus an ``events`` table, so each entity is derived from them by a fixed
rule that Spark and DuckDB compute alike (the rules are listed in FIXTURES.md section 3).
Every view is a projection/join of the given tables, so its size grows with them.

Each Spark builder has a matching SQL text (``SQL_VIEWS``) used by the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly-observation shape: station, time, obs_id, temp, dwpt, rhum, wdir, wspd, pres, coco."""
    ev = _read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value", _k().alias("k"))
    e = F.col("event_id")
    temp = F.when(e % 53 == 0, F.lit(None)).otherwise((e * 13 % 450) / F.lit(10e0) - 10)
    return ev.select(
        F.col("user_id").alias("station"),
        F.col("ts").alias("time"),
        e.alias("obs_id"),
        temp.cast("double").alias("temp"),
        F.when(e % 53 == 0, F.lit(None)).otherwise(
            (e * 13 % 450) / F.lit(10e0) - 10 - F.col("k") / F.lit(10e0)).cast("double").alias("dwpt"),
        F.col("k").cast("double").alias("rhum"),
        F.when(e % 17 == 0, F.lit(None)).otherwise(
            ((e * 37 + F.col("k") * 11) % 360).cast("double")).alias("wdir"),
        F.when(e % 41 == 0, F.lit(None)).otherwise(F.col("value") / F.lit(10e0)).cast("double").alias("wspd"),
        (F.lit(985) + (e * 7 % 400) / F.lit(10e0)).alias("pres"),
        (F.lit(1) + e % 27).cast("int").alias("coco"),
    )


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station dimension: one row per distinct observing station, placed by rule."""
    st = _read(spark, sf_dir, "events").select(F.col("user_id").alias("station")).distinct()
    nation = _read(spark, sf_dir, "nation")
    region = _read(spark, sf_dir, "region")
    s = F.col("station")
    return (
        st.join(nation, nation.n_nationkey == s % 25)
        .join(region, region.r_regionkey == nation.n_regionkey)
        .select(
            s,
            F.col("r_name").alias("region"),
            F.col("n_name").alias("city"),
            (F.lit(25) + (s * 7 % 240) / F.lit(10e0)).alias("latitude"),
            (F.lit(-120) + (s * 13 % 450) / F.lit(10e0)).alias("longitude"),
            ((s * 31 % 2500) / F.lit(1e0)).alias("elevation"),
        )
    )


def events_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-track shape, one event per order: ev, station, magnitude, d, start point."""
    o = _read(spark, sf_dir, "orders").select("o_orderkey")
    base = o.select(F.col("o_orderkey").alias("ev"), F.col("o_orderkey").alias("q"))
    st = F.col("q") % 15
    return base.select(
        "ev",
        st.cast("bigint").alias("station"),
        (F.floor(F.col("q") / F.lit(7e0)) % 5).cast("int").alias("magnitude"),
        F.date_add(F.lit("2024-01-04").cast("date"), (F.col("q") % 24).cast("int")).alias("d"),
        # start point: the placed coordinates of the station, so the nearest-station search
        # (J4, k=1) must find it again
        (F.lit(25) + (st * 7 % 240) / F.lit(10e0)).alias("start_lat"),
        (F.lit(-120) + (st * 13 % 450) / F.lit(10e0)).alias("start_lon"),
    )


def normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly-normals shape from lineitem: month, day of year, four measures, direction code."""
    li = _read(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("row_key"),
        F.col("l_linenumber").alias("line"),
        F.col("l_shipdate").alias("ts"),
        F.month("l_shipdate").alias("month"),
        F.dayofyear("l_shipdate").alias("day_of_year"),
        "l_quantity", "l_discount", "l_tax", "l_extendedprice",
        (F.col("l_orderkey") % 10).cast("int").alias("dir_code"),  # 0 and 9 are no direction
    )


# ---------------------------------------------------------------------------------------------
# The same views as DuckDB SQL, for the oracle queries.
SQL_VIEWS = {
    "obs": """
obs AS (
  SELECT user_id AS station, ts AS time, event_id AS obs_id,
    CAST(CASE WHEN event_id % 53 = 0 THEN NULL ELSE (event_id*13 % 450)/10e0 - 10 END AS DOUBLE) AS temp,
    CAST(CASE WHEN event_id % 53 = 0 THEN NULL ELSE (event_id*13 % 450)/10e0 - 10 - k/10e0 END AS DOUBLE) AS dwpt,
    CAST(k AS DOUBLE) AS rhum,
    CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST((event_id*37 + k*11) % 360 AS DOUBLE) END AS wdir,
    CAST(CASE WHEN event_id % 41 = 0 THEN NULL ELSE value/10e0 END AS DOUBLE) AS wspd,
    985 + (event_id*7 % 400)/10e0 AS pres,
    CAST(1 + event_id % 27 AS INTEGER) AS coco
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
)""",
    "stations": """
stations AS (
  SELECT s.station, r_name AS region, n_name AS city,
    25 + (s.station*7 % 240)/10e0 AS latitude,
    -120 + (s.station*13 % 450)/10e0 AS longitude,
    (s.station*31 % 2500)/1e0 AS elevation
  FROM (SELECT DISTINCT user_id AS station FROM events) s
  JOIN nation ON n_nationkey = s.station % 25
  JOIN region ON r_regionkey = n_regionkey
)""",
    "events_dim": """
events_dim AS (
  SELECT o_orderkey AS ev, CAST(q % 15 AS BIGINT) AS station,
    CAST(CAST(floor(q/7e0) AS BIGINT) % 5 AS INTEGER) AS magnitude,
    date '2024-01-04' + CAST(q % 24 AS INTEGER) AS d,
    25 + ((q % 15)*7 % 240)/10e0 AS start_lat,
    -120 + ((q % 15)*13 % 450)/10e0 AS start_lon
  FROM (SELECT o_orderkey, o_orderkey AS q FROM orders)
)""",
    "normals": """
normals AS (
  SELECT l_orderkey AS row_key, l_linenumber AS line, l_shipdate AS ts,
    CAST(month(l_shipdate) AS INTEGER) AS month, CAST(dayofyear(l_shipdate) AS INTEGER) AS day_of_year,
    l_quantity, l_discount, l_tax, l_extendedprice,
    CAST(l_orderkey % 10 AS INTEGER) AS dir_code
  FROM lineitem
)""",
}


def with_views(body: str, *names: str) -> str:
    """Prefix an oracle query with the stand-in views it uses (in dependency order)."""
    if not names:
        return body.strip()
    ctes = ",".join(SQL_VIEWS[n] for n in names)
    body = body.strip()
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"
