"""Interval join with salted hot buckets against the plain condition."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from windlass.operators import intervals, temporal
from windlass.plans.events import event_window_wind


def pairs(df):
    return sorted((r["ev"], r["oid"]) for r in df.select("ev", "oid").collect())


@pytest.fixture(scope="module")
def tables(spark):
    rnd, t0 = random.Random(2), datetime(2024, 1, 1)
    obs = [(rnd.choice([0, 0, 0, 1, 2, 3]), i, t0 + timedelta(minutes=rnd.randint(0, 60 * 24 * 30))) for i in range(1500)]
    obs += [(0, 2000 + i, datetime(2024, 1, 9, 3)) for i in range(400)] + [(0, 3000, None), (None, 3001, t0)]
    ev = [(i, rnd.choice([0, 0, 0, 1, 5]), date(2024, 1, 1) + timedelta(days=rnd.randint(0, 30))) for i in range(120)]
    ev += [(1000 + i, 0, date(2024, 1, 8)) for i in range(150)] + [(2000, None, date(2024, 1, 5)), (2001, 1, None)]
    return (spark.createDataFrame(ev, "ev int, station int, d date").repartition(3),
            spark.createDataFrame(obs, "station int, oid int, time timestamp_ntz").repartition(4))


@pytest.mark.parametrize("hot_rows", [7, 100, 10 ** 6])
@pytest.mark.parametrize("block_hours", [1, 12, 24 * 50])
def test_interval_join_is_the_condition(tables, hot_rows, block_hours):
    ev, obs = tables
    got = temporal.event_window_join(ev, obs, 2, hot_rows=hot_rows, block_hours=block_hours)
    lo, hi = F.date_sub("d", 2).cast("timestamp_ntz"), F.date_add("d", 2).cast("timestamp_ntz")
    want = ev.join(obs.withColumnRenamed("station", "s"), F.col("s") == F.col("station")).filter(F.col("time").between(lo, hi))
    assert pairs(got) == pairs(want) and len(pairs(got)) > 10_000
    assert got.columns == ["station", "ev", "d", "oid", "time"]


def test_an_event_stands_in_two_blocks_at_most(tables, monkeypatch):
    ev, obs = tables
    seen, real = [], intervals.hot_buckets
    monkeypatch.setattr(intervals, "hot_buckets", lambda e, *a: seen.append(e) or real(e, *a))
    for days in (1, 3, 10):
        temporal.event_window_join(ev, obs, days)
        assert seen.pop().agg(F.max(F.col("__last") - F.col("__first") + 1)).first()[0] <= 2


def test_before_1970_empty_and_turned_intervals(spark):
    ev = spark.createDataFrame([(1, 1, datetime(1969, 12, 30), datetime(1970, 1, 2)), (2, 1, datetime(1970, 1, 2), datetime(1970, 1, 1))],
                               "ev int, station int, a timestamp_ntz, b timestamp_ntz")
    obs = spark.createDataFrame([(1, i, datetime(1969, 12, 29) + timedelta(hours=i)) for i in range(120)], "station int, oid int, time timestamp_ntz")
    got = pairs(intervals.interval_join(ev, obs, "station", F.col("a"), F.col("b"), block_hours=5))
    assert got == [(1, i) for i in range(24, 97)]
    assert intervals.interval_join(ev.limit(0), obs, "station", F.col("a"), F.col("b")).count() == 0
    assert intervals.interval_join(ev, obs.limit(0), "station", F.col("a"), F.col("b")).count() == 0


def test_no_task_above_a_tenth_when_all_events_share_a_station(spark):
    """5,000 events of one station and day: the join's rows lie in many tasks."""
    ev = spark.range(5000).select(F.col("id").alias("ev"), F.lit(1).alias("magnitude"), F.lit("2024-01-10").cast("date").alias("d"),
                                  F.lit(40.0).alias("start_lat"), F.lit(-75.0).alias("start_lon"))
    st = spark.createDataFrame([(1, 40.0, -75.0), (2, 10.0, 10.0)], "station long, latitude double, longitude double")
    obs = spark.range(145).select(F.lit(1).cast("long").alias("station"),
                                  F.expr("timestamp_ntz'2024-01-07' + make_interval(0,0,0,0,CAST(id AS INT))").alias("time"),
                                  F.col("id").cast("double").alias("wspd"), F.lit(1.0).alias("wdir"))
    set_ = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "64"}
    before = {k: spark.conf.get(k, None) for k in set_}
    for k, v in set_.items():
        spark.conf.set(k, v)
    try:
        out = event_window_wind(ev, st, obs, hot_rows=100)
        per = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sum(per) == 5000 * 145
    assert max(per) <= 0.1 * sum(per)
