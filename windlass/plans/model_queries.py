"""Registered queries for metrics, sampling/splits and model data preparation
(A17-A21, J2, J7, J8, F22, W9, W10, S9, X2-X4, A11-A12, U2, L1-L2 data side).

Model stand-ins without a trained model: wind = lag-1 speed, direction = lag-1 direction,
condition class = class of ``1 + (coco * 2) % 22``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windlass.functions.scalar import CONDITION_4, condition_group_4, wind_u, wind_v, arrow_end
from windlass.operators import metrics as mx
from windlass.operators.aggregates import round_doubles
from windlass.operators.reshape import drop_any_null, pivot_ranks
from windlass.operators.sampling import hash_order, sample_n, split_by_hash
from windlass.operators.selection import pick_id
from windlass.operators.spatial import k_nearest
from windlass.operators.sequence import with_lags
from windlass.operators.temporal import running_id, time_folds
from windlass.plans.registry import (R, bucket_sql, circ_sql, hash_sql, haversine_sql, pmod360_sql,
                                     query)
from windlass.session import wide_plan_mode
from windlass.sources import standins as sv

LABELS_4 = list(CONDITION_4)
W = "PARTITION BY station ORDER BY time"


def _case4(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} IN ({', '.join(map(str, v))}) THEN '{k}'"
                              for k, v in CONDITION_4.items()) + " END"


def class_predictions(obs: DataFrame) -> DataFrame:
    return obs.select("station", "time", condition_group_4("coco").alias("true_label"),
                      condition_group_4(F.lit(1) + (F.col("coco") * 2) % 22).alias("predicted_label"))


_CLASS_SQL = f"t AS (SELECT station, time, {_case4('coco')} AS true_label, {_case4('(1 + (coco * 2) % 22)')} AS predicted_label FROM obs)"
_GRID_SQL = ("g AS (SELECT a.l AS true_label, b.l AS predicted_label FROM (VALUES " +
             ", ".join(f"('{x}')" for x in LABELS_4) + ") a(l), (VALUES " +
             ", ".join(f"('{x}')" for x in LABELS_4) + ") b(l))")


@query("confusion_percent", "A17 J8 F15 F16", views=("obs",), sql=f"""
WITH {_CLASS_SQL}, {_GRID_SQL},
c AS (SELECT true_label, predicted_label, count(*) AS count FROM t
      WHERE true_label IS NOT NULL AND predicted_label IS NOT NULL GROUP BY 1, 2),
f AS (SELECT g.true_label, g.predicted_label, coalesce(c.count, 0) AS count FROM g LEFT JOIN c USING (true_label, predicted_label)),
p AS (SELECT *, coalesce(count * 100e0 / nullif(sum(count) OVER (PARTITION BY true_label), 0), 0e0) AS pct FROM f)
SELECT true_label, predicted_label, count, {R('pct')} AS percentage, printf('%.1f%%', round(pct, 1)) AS text FROM p
""")
def q_confusion_percent(spark, d):
    p = class_predictions(sv.obs(spark, d))
    return round_doubles(mx.confusion_percent(p, LABELS_4, "true_label", "predicted_label"), 6)


@query("station_accuracy", "A19 J1", views=("obs", "stations"), sql=f"""
WITH {_CLASS_SQL}
SELECT station, {R('accuracy')} AS accuracy, samples, latitude, longitude FROM (
  SELECT station, avg(CASE WHEN true_label = predicted_label THEN 1e0 ELSE 0e0 END) AS accuracy, count(*) AS samples
  FROM t WHERE true_label IS NOT NULL AND predicted_label IS NOT NULL GROUP BY station
) JOIN stations USING (station) WHERE samples > 10
""")
def q_station_accuracy(spark, d):
    p = class_predictions(sv.obs(spark, d)).dropna(subset=["true_label", "predicted_label"])
    acc = mx.group_accuracy(p, "station", "true_label", "predicted_label", min_rows=10)
    st = sv.stations(spark, d).select("station", "latitude", "longitude")
    return round_doubles(acc.join(st, "station"), 6)


@query("overall_accuracy", "A18", views=("obs",), sql=f"""
WITH {_CLASS_SQL}
SELECT {R('avg(CASE WHEN true_label = predicted_label THEN 1e0 ELSE 0e0 END)')} AS accuracy, count(*) AS n
FROM t WHERE true_label IS NOT NULL AND predicted_label IS NOT NULL
""")
def q_overall_accuracy(spark, d):
    p = class_predictions(sv.obs(spark, d)).dropna(subset=["true_label", "predicted_label"])
    eq = F.when(F.col("true_label") == F.col("predicted_label"), 1.0).otherwise(0.0)
    return round_doubles(p.agg(F.avg(eq).alias("accuracy"), F.count(F.lit(1)).alias("n")), 6)


def _lagged(obs: DataFrame) -> DataFrame:
    """Lag-1 speed and direction per station as the stand-in prediction."""
    return with_lags(obs, ["wspd", "wdir"], [1]).withColumnsRenamed(
        {"wspd_lag1": "wspd_pred", "wdir_lag1": "wdir_pred"})


_REG_SQL = """
WITH p AS (SELECT wspd AS actual, lag(wspd, 1) OVER ({W}) AS predicted FROM obs),
r AS (SELECT * FROM p WHERE actual IS NOT NULL AND predicted IS NOT NULL),
m AS (SELECT avg(actual) AS mean0 FROM r),
s AS (SELECT count(*) AS n, sum(pow(actual - predicted, 2)) AS sse, sum(pow(actual - m.mean0, 2)) AS sst,
        sum(abs(actual - predicted)) AS sae FROM r, m)
SELECT {r2} AS r2, {mse} AS mse, {rmse} AS rmse, {mae} AS mae, n FROM s
""".format(W=W, r2=R("CASE WHEN sst <> 0 THEN 1e0 - sse / sst ELSE 0e0 END"), mse=R("sse / n"),
           rmse=R("sqrt(sse / n)"), mae=R("sae / n"))


@query("regression_metrics", "A20", views=("obs",), sql=_REG_SQL)
def q_regression_metrics(spark, d):
    return round_doubles(mx.regression_metrics(_lagged(sv.obs(spark, d)), [("wspd", "wspd_pred")]), 6)


def _uv_sql(sp: str, dr: str) -> tuple[str, str]:
    return f"{sp} * sin(radians({dr} + 180))", f"{sp} * cos(radians({dr} + 180))"


_U, _V = _uv_sql("wspd", "wdir")
_UP, _VP = _uv_sql(f"lag(wspd, 1) OVER ({W})", f"lag(wdir, 1) OVER ({W})")
_VEC_SQL = f"""
WITH p AS (SELECT {_U} AS u, {_V} AS v, {_UP} AS u_pred, {_VP} AS v_pred FROM obs),
r AS (SELECT * FROM p WHERE u IS NOT NULL AND u_pred IS NOT NULL AND v IS NOT NULL AND v_pred IS NOT NULL),
m AS (SELECT avg(u) AS mu, avg(v) AS mv FROM r),
s AS (SELECT count(*) AS n, sum(pow(u - u_pred, 2)) AS sse0, sum(pow(u - m.mu, 2)) AS sst0, sum(abs(u - u_pred)) AS sae0,
        sum(pow(v - v_pred, 2)) AS sse1, sum(pow(v - m.mv, 2)) AS sst1, sum(abs(v - v_pred)) AS sae1 FROM r, m)
SELECT {R("(0e0 + CASE WHEN sst0 <> 0 THEN 1e0 - sse0 / sst0 ELSE 0e0 END + CASE WHEN sst1 <> 0 THEN 1e0 - sse1 / sst1 ELSE 0e0 END) / 2")} AS r2,
  {R("(0e0 + sse0 / n + sse1 / n) / 2")} AS mse, {R("sqrt((0e0 + sse0 / n + sse1 / n) / 2)")} AS rmse,
  {R("(0e0 + sae0 / n + sae1 / n) / 2")} AS mae, n FROM s
"""


@query("vector_regression_metrics", "A20 F9 W3", views=("obs",), sql=_VEC_SQL)
def q_vector_regression_metrics(spark, d):
    o = _lagged(sv.obs(spark, d))
    o = o.withColumns({"u": wind_u("wspd", "wdir"), "v": wind_v("wspd", "wdir"),
                       "u_pred": wind_u("wspd_pred", "wdir_pred"), "v_pred": wind_v("wspd_pred", "wdir_pred")})
    return round_doubles(mx.regression_metrics(o, [("u", "u_pred"), ("v", "v_pred")]), 6)


@query("circular_r2", "A21 A2", views=("obs",), sql=f"""
WITH p AS (SELECT wdir AS actual, lag(wdir, 1) OVER ({W}) AS predicted FROM obs),
r AS (SELECT * FROM p WHERE actual IS NOT NULL AND predicted IS NOT NULL),
m AS (SELECT {circ_sql('actual')} AS md FROM r),
e AS (SELECT least(abs(actual - predicted), 360e0 - abs(actual - predicted)) AS err,
             least(abs(actual - {pmod360_sql('m.md')}), 360e0 - abs(actual - {pmod360_sql('m.md')})) AS merr FROM r, m)
SELECT {R('CASE WHEN coalesce(sum(pow(merr, 2)), 0) <> 0 THEN 1e0 - sum(pow(err, 2)) / sum(pow(merr, 2)) ELSE 0e0 END')} AS circular_r2,
  {R('(SELECT md FROM m)')} AS mean_direction, count(*) AS n FROM e
""")
def q_circular_r2(spark, d):
    return round_doubles(mx.circular_r2(_lagged(sv.obs(spark, d)), "wdir", "wdir_pred"), 6)


# ---- J2 + F22 + W9: prediction arrows on the map ------------------------------------------------------
def prediction_arrows(pred: DataFrame, stations: DataFrame, scale: float = 0.5, keep_repeats: bool = False) -> DataFrame:
    """Observed and predicted wind vectors placed at their station (J2), arrow ends (F22) and a running arrow id by station and time
    (W9). A station that the station table lists more than once has the place that is smallest by (longitude, latitude), or with
    ``keep_repeats`` an arrow for each of its places, as a plain join gives."""
    st = stations.select("station", "longitude", "latitude")
    if not keep_repeats:
        place = F.struct("longitude", "latitude")
        st = st.groupBy("station").agg(F.min_by(place, place).alias("p")).select("station", "p.longitude", "p.latitude")
    j = pred.join(st, "station", "left").withColumns({
        "end_lon": arrow_end("longitude", "u_obs", scale), "end_lat": arrow_end("latitude", "v_obs", scale),
        "end_lon_pred": arrow_end("longitude", "u_pred", scale),
        "end_lat_pred": arrow_end("latitude", "v_pred", scale)})
    return running_id(j, [F.col("station").asc(), F.col("time").asc(), F.col("longitude").asc(), F.col("latitude").asc()], "arrow_id")


_ARROWS_SQL = f"""
SELECT * EXCLUDE (wspd_p, wdir_p) FROM (
SELECT p.station, p.time, {R('u_obs')} AS u_obs, {R('v_obs')} AS v_obs, {R('u_pred')} AS u_pred, {R('v_pred')} AS v_pred,
  s.longitude, s.latitude, {R('s.longitude + u_obs * 0.5e0')} AS end_lon, {R('s.latitude + v_obs * 0.5e0')} AS end_lat,
  {R('s.longitude + u_pred * 0.5e0')} AS end_lon_pred, {R('s.latitude + v_pred * 0.5e0')} AS end_lat_pred,
  row_number() OVER (ORDER BY p.station, p.time) - 1 AS arrow_id, NULL AS wspd_p, NULL AS wdir_p
FROM (SELECT station, time, {_U} AS u_obs, {_V} AS v_obs, {_UP} AS u_pred, {_VP} AS v_pred FROM obs) p
LEFT JOIN stations s USING (station)
WHERE u_obs IS NOT NULL AND v_obs IS NOT NULL AND u_pred IS NOT NULL AND v_pred IS NOT NULL)
"""


def _stand_in_arrows(spark, d) -> DataFrame:
    o = _lagged(sv.obs(spark, d))
    p = o.select("station", "time", wind_u("wspd", "wdir").alias("u_obs"), wind_v("wspd", "wdir").alias("v_obs"),
                 wind_u("wspd_pred", "wdir_pred").alias("u_pred"),
                 wind_v("wspd_pred", "wdir_pred").alias("v_pred")).dropna()
    return prediction_arrows(p, sv.stations(spark, d))


@query("prediction_arrows", "J2 F22 W9 F9", views=("obs", "stations"), sql=_ARROWS_SQL)
def q_prediction_arrows(spark, d):
    return round_doubles(_stand_in_arrows(spark, d), 6)


@query("picked_arrow", "P17 W9 J2", views=("obs", "stations"), sql=f"SELECT * FROM ({_ARROWS_SQL}) WHERE arrow_id = 100")
def q_picked_arrow(spark, d):
    """The slider's pick: one arrow by its running id."""
    return round_doubles(pick_id(_stand_in_arrows(spark, d), "arrow_id", 100), 6)


# ---- S9: first station with data among a place's nearest ----------------------------------------------
def nation_places(spark, d) -> DataFrame:
    """Stand-in places: every nation placed by the station placement rule."""
    n = spark.read.parquet(f"{d}/nation.parquet")
    k = F.col("n_nationkey")
    return n.select(k.alias("place"), F.col("n_name").alias("city"),
                    (F.lit(25) + (k * 7 % 240) / F.lit(10e0)).alias("latitude"),
                    (F.lit(-120) + (k * 13 % 450) / F.lit(10e0)).alias("longitude"))


def first_nonempty_station(places: DataFrame, stations: DataFrame, obs: DataFrame, start: str, end: str,
                           k: int = 10) -> DataFrame:
    """Among each place's k nearest stations, the closest one with any observation in
    [start, end]; places without such a station are left out."""
    near = k_nearest(places, stations, k, place_key="place")
    o = obs.filter(F.col("time").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
    counts = o.groupBy("station").agg(F.count(F.lit(1)).alias("n_obs"))
    cand = near.join(counts, "station")
    w = F.min("rank").over(__import__("pyspark.sql", fromlist=["Window"]).Window.partitionBy("place"))
    return cand.withColumn("__m", w).filter(F.col("rank") == F.col("__m")).drop("__m")


@query("first_nonempty_station", "S9 J4", views=("obs", "stations"), sql=f"""
WITH pl AS (SELECT n_nationkey AS place, n_name AS city, 25 + (n_nationkey * 7 % 240) / 10e0 AS latitude,
              -120 + (n_nationkey * 13 % 450) / 10e0 AS longitude FROM nation),
near AS (SELECT * FROM (SELECT pl.*, s.station, {haversine_sql('pl.latitude', 'pl.longitude', 's.latitude', 's.longitude')} AS dist,
           row_number() OVER (PARTITION BY pl.place ORDER BY {haversine_sql('pl.latitude', 'pl.longitude', 's.latitude', 's.longitude')}, s.station) AS rank
         FROM pl, stations s) WHERE rank <= 10),
c AS (SELECT station, count(*) AS n_obs FROM obs WHERE time BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-11 00:00:00' GROUP BY station),
j AS (SELECT near.*, c.n_obs FROM near JOIN c USING (station))
SELECT place, city, latitude, longitude, station, {R('dist')} AS distance_km, CAST(rank AS INTEGER) AS rank, n_obs
FROM j WHERE rank = (SELECT min(rank) FROM j j2 WHERE j2.place = j.place)
""")
def q_first_nonempty_station(spark, d):
    r = first_nonempty_station(nation_places(spark, d), sv.stations(spark, d), sv.obs(spark, d),
                               "2024-01-10 00:00:00", "2024-01-11 00:00:00")
    return round_doubles(r, 6)


# ---- L2 on one feature: least squares = regr_slope / regr_intercept ------------------------------------
@query("linear_slope", "L2 A20", views=("obs",), sql=f"""
SELECT station, {R('regr_slope(wspd, pres)')} AS slope, {R('regr_intercept(wspd, pres)')} AS intercept,
  CAST(regr_count(wspd, pres) AS BIGINT) AS n FROM obs GROUP BY station
""")
def q_linear_slope(spark, d):
    o = sv.obs(spark, d)
    return round_doubles(o.groupBy("station").agg(
        F.regr_slope("wspd", "pres").alias("slope"), F.regr_intercept("wspd", "pres").alias("intercept"),
        F.regr_count("wspd", "pres").cast("bigint").alias("n")), 6)


# ---- X2 + J7: station split; X3 plot sample; X4 row split; W10 time folds -------------------------------
def station_split(stations: DataFrame, n_train: int, seed: int = 42) -> DataFrame:
    """X2 + J7: ``n_train`` stations by hash order; the rest (anti join) are test stations."""
    train = sample_n(stations.select("station"), n_train, "station", seed)
    test = stations.select("station").join(train, "station", "left_anti")
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


@query("station_split", "X2 J7", views=("stations",), sql=f"""
SELECT station, CASE WHEN row_number() OVER (ORDER BY {hash_sql('station')}, station) <= 40 THEN 'train' ELSE 'test' END AS split
FROM stations
""")
def q_station_split(spark, d):
    return station_split(sv.stations(spark, d), 40)


@query("plot_sample", "X3", views=("obs",), sql=f"""
SELECT obs_id, station, wspd, wdir FROM obs ORDER BY {hash_sql('obs_id')}, obs_id LIMIT 2000
""")
def q_plot_sample(spark, d):
    return sample_n(sv.obs(spark, d).select("obs_id", "station", "wspd", "wdir"), 2000, "obs_id")


@query("row_split", "X4", views=("obs",), sql=f"""
SELECT obs_id, CASE WHEN {bucket_sql('obs_id')} < 80 THEN 'train' ELSE 'test' END AS split FROM obs
""")
def q_row_split(spark, d):
    return split_by_hash(sv.obs(spark, d).select("obs_id"), "obs_id", 80)


@query("time_folds", "W10 X6", views=("obs",), sql=f"""
WITH x AS (SELECT station, time, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY station) AS n FROM obs),
y AS (SELECT *, least(5, greatest(2, floor(n / 500))) AS k FROM x),
z AS (SELECT *, floor(n / (k + 1)) AS size FROM y),
f AS (SELECT z.*, unnest(range(0, CAST(k AS BIGINT))) AS fold FROM z),
r AS (SELECT *, CASE WHEN i >= n - (k - fold) * size AND i < n - (k - fold - 1) * size THEN 'test'
                     WHEN i < n - (k - fold) * size THEN 'train' END AS role FROM f)
SELECT station, time, CAST(i AS INTEGER) AS row_index, CAST(fold AS INTEGER) AS fold, role FROM r WHERE role IS NOT NULL
""")
def q_time_folds(spark, d):
    o = sv.obs(spark, d).select("station", "time")
    return time_folds(o, "station", ["time"]).select(
        "station", "time", "row_index", "fold", "role")


# ---- L1 data: wind-vector pivot of each main station and its 6 nearest --------------------------------
def wind_vector_table(obs: DataFrame, stations: DataFrame, mains: DataFrame, k: int = 6,
                      bucket: str = "HOUR") -> DataFrame:
    """L1: wind vectors (F9) averaged per (time bucket, station) (A11), joined to the mains whose k nearest stations they are (J4), and
    turned to one row per (time, main station) with ``{u,v,longitude,latitude}_{rank}`` (A12); rows with any gap are dropped.

    A (main, rank) has one station, so the mean per station is the mean per (main, rank): observations are aggregated before the join, which
    then copies one row per station and bucket, not every observation."""
    wide_plan_mode(obs.sparkSession)
    nb = k_nearest(mains.select(F.col("station").alias("place"), "latitude", "longitude"), stations, k,
                   place_key="place").select("place", "station", "rank")
    coords = stations.groupBy("station").agg(F.avg("longitude").alias("longitude"), F.avg("latitude").alias("latitude"))
    nb = nb.join(coords, "station")
    o = obs.select("station", F.date_trunc(bucket, "time").cast("timestamp_ntz").alias("time"),
                   wind_u("wspd", "wdir").alias("u"), wind_v("wspd", "wdir").alias("v"))
    a = o.groupBy("station", "time").agg(F.avg("u").alias("u"), F.avg("v").alias("v")).join(nb, "station").drop("station")
    p = pivot_ranks(a, ["time", "place"], "rank", list(range(1, k + 1)), ["u", "v", "longitude", "latitude"])
    return drop_any_null(p).withColumnRenamed("place", "station")


def wind_vector_union(obs: DataFrame, stations: DataFrame, mains: Sequence[DataFrame], k: int = 6, bucket: str = "HOUR") -> DataFrame:
    """The tables of several groups of mains, one after the other, each row once (groups may share mains)."""
    tables = [wind_vector_table(obs, stations, m, k, bucket) for m in mains]
    return reduce(DataFrame.unionByName, tables).distinct()


def _pivot_sql(bucket: str = "day", mains: str = "true") -> str:
    cols = ", ".join(f"{R(f'max(CASE WHEN rank = {r} THEN {v} END)')} AS {v}_{r}"
                     for r in range(1, 7) for v in ("u", "v", "longitude", "latitude"))
    notnull = " AND ".join(f"{v}_{r} IS NOT NULL" for r in range(1, 7) for v in ("u", "v", "longitude", "latitude"))
    hv = haversine_sql('m.latitude', 'm.longitude', 's.latitude', 's.longitude')
    return f"""
WITH m AS (SELECT station AS place, latitude, longitude FROM stations WHERE {mains}),
nb AS (SELECT place, station, rank FROM (SELECT m.place, s.station,
         row_number() OVER (PARTITION BY m.place ORDER BY {hv}, s.station) AS rank FROM m, stations s) WHERE rank <= 6),
o AS (SELECT station, date_trunc('{bucket}', time) AS time, {_U} AS u, {_V} AS v FROM obs),
a AS (SELECT o.time, nb.rank, nb.place, avg(o.u) AS u, avg(o.v) AS v, avg(s.longitude) AS longitude, avg(s.latitude) AS latitude
      FROM o JOIN nb USING (station) JOIN stations s USING (station) GROUP BY o.time, nb.rank, nb.place),
p AS (SELECT time, place AS station, {cols} FROM a GROUP BY time, place)
SELECT DISTINCT * FROM p WHERE {notnull}
"""


@query("wind_vector_pivot", "L1 J4 F9 A11 A12 P7", views=("obs", "stations"), sql=_pivot_sql())
def q_wind_vector_pivot(spark, d):
    st = sv.stations(spark, d)
    return round_doubles(wind_vector_table(sv.obs(spark, d), st, st, bucket="DAY"), 6)


@query("wind_vector_union", "U2 L1 A12", views=("obs", "stations"), sql=_pivot_sql(mains="station % 2 = 0 OR station % 3 = 0"))
def q_wind_vector_union(spark, d):
    """Two groups of mains that overlap."""
    st = sv.stations(spark, d)
    groups = [st.filter("station % 2 = 0"), st.filter("station % 3 = 0")]
    return round_doubles(wind_vector_union(sv.obs(spark, d), st, groups, bucket="DAY"), 6)
