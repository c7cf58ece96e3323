"""Merged daily states against aggregates over all observations."""

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from windlass.functions.circular import circular_mean
from windlass.operators import daily_state as ds


@pytest.fixture(scope="module")
def obs(spark):
    rnd, t0 = random.Random(6), datetime(2023, 12, 20)
    rows = [(rnd.choice([0, 0, 1, 2, 3, 4]), t0 + timedelta(hours=rnd.randint(0, 24 * 60)), None if rnd.random() < 0.1 else 1000 + rnd.gauss(0, 0.5),
             None if rnd.random() < 0.1 else rnd.choice([350.0, 10.0, 0.0, 180.0, 90.0])) for _ in range(6000)]
    rows += [(9, t0, None, None), (9, t0 + timedelta(days=1), 5.0, None), (None, t0, 7.0, 1.0), (1, None, 1e9, 5.0)]
    return spark.createDataFrame(rows, "station int, time timestamp_ntz, wspd double, wdir double").repartition(5).cache()


def direct(obs, keys):
    return obs.filter("time IS NOT NULL").groupBy(*keys).agg(F.count("wspd").alias("n"), F.avg("wspd").alias("mean"), F.min("wspd").alias("low"), F.max("wspd").alias("high"),
                                 F.stddev_samp("wspd").alias("std"), circular_mean("wdir").alias("deg"))


def finished(state, keys):
    return ds.merge(state, keys).select(*[k if isinstance(k, str) else "half" for k in keys], F.col("wspd_n").alias("n"), ds.mean_of_state("wspd").alias("mean"),
                                        F.col("wspd_min").alias("low"), F.col("wspd_max").alias("high"), ds.std_of_state("wspd").alias("std"),
                                        ds.direction_of_state("wdir").alias("deg"))


def same(a, b, by):
    a, b = (x.toPandas().sort_values(by).reset_index(drop=True) for x in (a, b))
    pd.testing.assert_frame_equal(a, b[a.columns], check_exact=False, rtol=1e-9, atol=1e-9)
    assert len(a)


def test_merged_states_are_the_direct_aggregates(obs):
    state = ds.daily_state(obs).cache()
    same(finished(state, ["station"]), direct(obs, ["station"]), ["station"])
    same(finished(state, ["date"]), direct(obs, [F.to_date("time").alias("date")]), ["date"])
    whole = ds.merge(ds.merge(ds.merge(state, ["station", F.dayofmonth("date").alias("day")]), ["day"]), [])  # states of states
    row, want = whole.first(), direct(obs, []).first()
    assert row["wspd_n"] == want["n"] and np.isclose(row["wspd_sum"] / row["wspd_n"], want["mean"], rtol=1e-12)
    assert np.isclose(np.sqrt(row["wspd_m2"] / (row["wspd_n"] - 1)), want["std"], rtol=1e-7)


def test_stored_state_is_read_by_range_and_grows_by_days(spark, obs, tmp_path):
    path = str(tmp_path / "state")
    first = obs.filter("time < '2024-01-10 12:00:00'")
    ds.write_daily_state(ds.daily_state(first), path)
    ds.write_daily_state(ds.daily_state(obs.filter("time >= '2024-01-10 12:00:00'")), path, "append")  # the day in two parts
    got = ds.read_daily_state(spark, path, "2023-12-25", "2024-01-31")
    want = obs.filter("time >= '2023-12-25' AND time < '2024-02-01'")
    same(finished(got, ["station"]), direct(want, ["station"]), ["station"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan
    assert ds.daily_state(obs.limit(0)).count() == 0


def test_sketches_merge_to_quantiles_within_their_error(spark):
    values = np.random.default_rng(3).gamma(2, 8, 60_000)
    obs = spark.createDataFrame(pd.DataFrame({"station": np.arange(60_000) % 7, "wspd": values, "wdir": 1.0,
                                              "day": np.arange(60_000) % 40})).withColumn("time", F.expr("timestamp_ntz'2024-01-01' + make_interval(0,0,0,CAST(day AS INT))"))
    probs = [0.05, 0.25, 0.5, 0.75, 0.95]
    state = ds.merge(ds.daily_state(obs, sketches=["wspd"]), [])
    got = state.select(ds.quantiles_of_state("wspd", probs).alias("q")).first()["q"]
    ranks = [(values <= v).mean() for v in got]
    assert np.allclose(ranks, probs, atol=0.015)
    none = ds.merge(ds.daily_state(obs.withColumn("wspd", F.lit(None).cast("double")), sketches=["wspd"]), [])
    assert none.select(ds.quantiles_of_state("wspd", probs).alias("q")).first()["q"] is None
