"""(station, day) pieces with a halo, and the stored layout, against the plain window over a station."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from windlass.operators import temporal
from windlass.operators.pieces import OWN, PIECE, with_halo
from windlass.operators.sequence import with_lags
from windlass.plans import features as fx
from windlass.sources import layout

RAW = "temp double, dwpt double, rhum double, wdir double, wspd double, pres double, coco int"


@pytest.fixture(scope="module")
def hot(spark):
    """One station holds two thirds of the rows; times repeat, days are missing or hold a single row, some times are null."""
    rnd, t0, rows = random.Random(11), datetime(2024, 1, 1), []
    for i in range(2400):
        station = 0 if i % 3 else 1 + i % 5
        time = None if i % 400 == 7 else t0 + timedelta(hours=rnd.randint(0, 24 * 40)) if station else t0 + timedelta(minutes=10 * (i // 2))
        rows.append((station, i, time, None if rnd.random() < 0.1 else rnd.uniform(-5, 30), rnd.uniform(-10, 20), rnd.uniform(0, 100),
                     rnd.uniform(0, 359), rnd.uniform(0, 60), rnd.uniform(980, 1030), rnd.randint(1, 27)))
    rows += [(99, 5000, t0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1), (None, 5001, t0, 2.0, 2.0, 2.0, 2.0, 2.0, 2.0, 2)]
    return spark.createDataFrame(rows, f"station long, obs_id int, time timestamp_ntz, {RAW}").repartition(7).cache()


def plain(columns=("time", "obs_id")):
    return Window.partitionBy("station").orderBy(F.col(columns[0]).asc_nulls_last(), *columns[1:])


def frame(df):
    return df.toPandas().sort_values("obs_id").reset_index(drop=True)


@pytest.mark.parametrize("chunk", [None, "month", "hour"])
def test_lags_in_pieces_are_those_of_the_station(hot, chunk):
    got = with_lags(hot, ["temp", "wspd"], [1, 3, 5], chunk=F.date_trunc(chunk, "time") if chunk else None)
    want = temporal.lag_block(hot, ["temp", "wspd"], [1, 3, 5], plain())
    assert got.columns == want.columns
    pd.testing.assert_frame_equal(frame(got), frame(want))


def test_rolling_statistics_in_pieces_are_those_of_the_station(hot):
    acc = fx.WindowColumns(plain())
    want = hot.select("obs_id", *[(acc.lag(c, 0) - acc.lag(c, 1)).alias(f"{c}_change") for c in fx.DIFF_COLS],
                      *[acc.mean3(v).alias(k) for k, v in fx.TREND_COLS.items()], *[acc.std3(v).alias(k) for k, v in fx.VOLATILITY_COLS.items()])
    pd.testing.assert_frame_equal(frame(fx.diff_roll(hot).select(*want.columns)), frame(want), check_exact=False, rtol=1e-12)
    g = fx.global_thresholds(hot)
    want = hot.select("obs_id", *[v.alias(n) for n, v in fx.derived_columns(g, acc).items()])
    pd.testing.assert_frame_equal(frame(fx.derived_features(hot, g).select(*want.columns)), frame(want), check_exact=False, rtol=1e-12)


def test_feature_table_in_pieces_is_that_of_the_station(hot):
    st = hot.sparkSession.createDataFrame([(i, 40.0 + i, -80.0 - i, 100.0 * i) for i in range(6)],
                                          "station long, latitude double, longitude double, elevation double")
    g = fx.global_thresholds(hot)
    # distinct times, as the feature table's own tie column is the temperature
    one = hot.dropDuplicates(["station", "time"])
    got = fx.feature_table(one, st, g).toPandas().sort_values(["station", "time"]).reset_index(drop=True)
    lagged = temporal.lag_block(one.select("station", "time", *fx.RAW, "coco"), fx.RAW, [1, 2, 3, 4, 5], plain(("time",)))
    cols = {}
    for k in range(4):
        acc = fx.LagColumns(shift=k)
        for n, e in ({c: acc.lag(c, 0) for c in fx.RAW} | fx.derived_columns(g, acc)).items():
            cols[n if k == 0 else f"{n}_lag{k}"] = e
    want = lagged.select("station", "time", "coco", *[e.alias(n) for n, e in cols.items()]).dropna().filter("coco not between 23 and 27")
    want = want.toPandas().sort_values(["station", "time"]).reset_index(drop=True)
    assert len(got) > 300
    pd.testing.assert_frame_equal(got[want.columns], want)


def test_positions_and_folds_keep_null_times_and_ties(hot):
    got = frame(temporal.sequence_index(hot, "station", "time", tie="obs_id").select("obs_id", "seq"))
    want = frame(hot.select("obs_id", (F.row_number().over(plain()) - 1).alias("seq")))
    assert got["seq"].tolist() == want["seq"].tolist()
    folds = temporal.time_folds(hot.filter("station IS NOT NULL"), "station", ["time", "obs_id"]).toPandas()
    first = folds[folds.role == "test"].groupby(["station", "fold"]).row_index.agg(["min", "max", "count"])
    assert (first["max"] - first["min"] + 1 == first["count"]).all()


def test_no_piece_holds_a_hot_station(hot):
    """No group of the window holds more than a day of the hot station, though that has two thirds of the rows."""
    pieces = with_halo(hot, 5, ["temp"])
    sizes = pieces.groupBy("station", PIECE).agg(F.count(F.lit(1)).alias("n"), F.sum((~F.col(OWN)).cast("int")).alias("halo")).toPandas()
    assert sizes["n"].max() < 0.1 * hot.count() and sizes["halo"].max() == 5
    lines = fx.diff_roll(hot)._jdf.queryExecution().executedPlan().toString().splitlines()
    specs = [line.split("], [")[-2] for line in lines if line.lstrip(" :+-*()0123456789").startswith("Window [")]
    # the only window on the station alone is that of the tails, one row a piece
    assert len(specs) >= 2 and sum(PIECE not in s for s in specs) == 1


def test_little(spark, hot):
    assert with_lags(hot.limit(0), ["temp"], [1, 2]).count() == 0
    one = with_lags(hot.filter("station = 99"), ["temp"], [1, 2]).collect()
    assert len(one) == 1 and one[0]["temp_lag1"] is None
    none = with_lags(hot.filter("station = 99"), ["temp"], [])
    assert none.columns == hot.columns and none.count() == 1


# ---- stored layout -------------------------------------------------------------------------------
def no_exchange(df):
    list(map(str, df.collect()))
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "Exchange" not in plan and "Sort " not in plan and "Sort(" not in plan


def test_stored_layout_needs_no_exchange_for_lags(spark, hot, tmp_path):
    stored = layout.write_station_layout(hot, "obs_layout", str(tmp_path), 6, fx.RAW, back=3)
    got = layout.layout_lags(stored, hot.columns, fx.RAW, [1, 2, 3])
    assert no_exchange(got)
    pd.testing.assert_frame_equal(frame(got), frame(temporal.lag_block(hot, fx.RAW, [1, 2, 3], plain())))
    files = list((tmp_path / "obs_layout").glob("part-*"))
    assert 1 < len(files) <= 6
    spark.sql("DROP TABLE obs_layout")
    again = layout.open_layout(spark, stored, "obs_layout", str(tmp_path), 6, ["station", PIECE], ["station", PIECE, OWN, "time", "obs_id"])
    got = layout.layout_lags(again, hot.columns, ["temp"], [2])
    assert no_exchange(got) and got.count() == hot.count()
    spark.sql("DROP TABLE obs_layout")


def test_station_buckets_join_without_exchange(spark, hot, tmp_path):
    st = spark.createDataFrame([(i, f"city{i % 2}") for i in range(6)], "station long, city string")
    left = layout.write_station_buckets(hot.filter("station > 0"), "obs_by_station", str(tmp_path), 4, sort=["time"])
    right = layout.write_station_buckets(st, "station_dim", str(tmp_path), 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = left.join(right, "station").groupBy("station").agg(F.avg("temp").alias("t"), F.first("city").alias("city"))
        assert no_exchange(joined)
        assert joined.count() == 5
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE obs_by_station")
        spark.sql("DROP TABLE station_dim")
