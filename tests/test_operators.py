"""Hand-made fixtures per operator: nulls, ties, one-row groups, empty input, wrap-around."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from windlass.functions import scalar as fs
from windlass.functions.circular import angular_error, circular_mean, degrees_from_sin_cos, sin_cos
from windlass.operators import aggregates as agg
from windlass.operators import metrics as mx
from windlass.operators import quantiles, reshape, sampling, selection, temporal
from windlass.operators.joins import not_in_keep_null, reindex
from windlass.operators.spatial import haversine_km, k_nearest


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


# ---- circular statistics -------------------------------------------------------------------------------
def test_circular_mean_wraps_around_north(spark):
    df = spark.createDataFrame([("a", 350.0), ("a", 10.0), ("b", 90.0), ("b", None), ("c", None)],
                               "g string, d double")
    out = {r["g"]: r["m"] for r in df.groupBy("g").agg(circular_mean("d").alias("m")).collect()}
    assert out["a"] == pytest.approx(0.0, abs=1e-9) or out["a"] == pytest.approx(360.0, abs=1e-9)
    assert out["b"] == pytest.approx(90.0)
    assert out["c"] is None  # no direction -> null, not an error


def test_circular_mean_invariant_under_full_turns_and_rotates(spark):
    vals = [random.Random(1).uniform(0, 360) for _ in range(50)]
    df = spark.createDataFrame([(v, v + 360.0, (v + 40.0) % 360) for v in vals], "a double, b double, c double")
    r = df.agg(circular_mean("a").alias("a"), circular_mean("b").alias("b"), circular_mean("c").alias("c")).first()
    assert r["a"] == pytest.approx(r["b"], abs=1e-9)
    assert (r["c"] - r["a"]) % 360 == pytest.approx(40.0, abs=1e-6)


def test_angular_error_and_decoding(spark):
    df = spark.createDataFrame([(350.0, 10.0), (90.0, 270.0), (0.0, 0.0)], "a double, p double")
    errs = [r[0] for r in df.select(angular_error("a", "p")).collect()]
    assert errs == [20.0, 180.0, 0.0]
    s, c = sin_cos("a")
    back = [r[0] for r in df.select(degrees_from_sin_cos(s, c)).collect()]
    assert back[0] == pytest.approx(350.0) and back[1] == pytest.approx(90.0) and back[2] == pytest.approx(0.0)


# ---- Spark vs pandas semantics -------------------------------------------------------------
def test_bround_is_half_even(spark):
    r = spark.range(1).select(F.bround(F.lit(2.5), 0).alias("a"), F.bround(F.lit(3.5), 0).alias("b")).first()
    assert (r["a"], r["b"]) == (2.0, 4.0)


def test_percentile_interpolates_like_numpy(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "x double")
    assert df.agg(agg.quantile("x", 0.9).alias("q")).first()["q"] == pytest.approx(np.quantile([1, 2, 4], 0.9))


def test_describe_matches_pandas(spark):
    data = [1.0, 2.0, 2.0, 5.0, None, 9.0]
    df = spark.createDataFrame([(x,) for x in data], "x double")
    out = {r["statistic"]: r["x"] for r in agg.describe(df, ["x"], digits=6).collect()}
    ref = pd.Series(data).describe()
    for k in ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]:
        assert out[k] == pytest.approx(round(ref[k], 6))


def test_mode_picks_smallest_of_ties_and_median(spark):
    from windlass.plans.station_queries import impute_median_mode
    df = spark.createDataFrame([(1.0, "b"), (None, "a"), (3.0, None), (10.0, "b"), (None, "a")], "x double, c string")
    out = impute_median_mode(df, ["x"], ["c"]).collect()
    assert [r["x"] for r in out] == [1.0, 3.0, 3.0, 10.0, 3.0]  # median of 1, 3, 10
    assert [r["c"] for r in out] == ["b", "a", "a", "b", "a"]  # a and b tie -> smallest


def test_not_in_keeps_null_like_pandas(spark):
    df = spark.createDataFrame([(1,), (23,), (None,)], "coco int")
    assert rows(df.filter(not_in_keep_null("coco", [23, 24])), "coco") == [(1,), (None,)]


def test_compass_label_safe_lookup(spark):
    df = spark.createDataFrame([(1,), (8,), (9,), (None,)], "code int")
    assert [r[0] for r in df.select(fs.compass_label("code")).collect()] == ["N", "NW", None, None]


def test_time_bins_left_closed(spark):
    df = spark.createDataFrame([(0,), (5,), (6,), (17,), (18,), (23,)], "h int")
    assert [r[0] for r in df.select(fs.time_bin("h")).collect()] == [
        "Night", "Night", "Morning", "Afternoon", "Early Morning", "Early Morning"]


def test_beaufort_null_falls_to_default(spark):
    df = spark.createDataFrame([(0.5,), (1.0,), (117.4,), (200.0,), (None,)], "w double")
    assert [r[0] for r in df.select(fs.beaufort("w")).collect()] == [0, 1, 12, 12, 12]


def test_condition_groups(spark):
    df = spark.createDataFrame([(1,), (5,), (17,), (21,), (23,), (None,), (30,)], "c int")
    four = [r[0] for r in df.select(fs.condition_group_4("c")).collect()]
    seven = [r[0] for r in df.select(fs.condition_group_7("c")).collect()]
    assert four == ["Clear", "Cloudy", "Rain", "Snow", None, None, None]
    assert seven == ["Clear", "Cloudy/Foggy", "Rain", "Cold Precip", "Extreme", "Unknown", "Other"]


def test_sector_and_blend_colour(spark):
    df = spark.createDataFrame([(0.0,), (44.9,), (45.0,), (180.0,), (315.0,), (None,)], "d double")
    got = df.select(fs.direction_sector("d").alias("s"), fs.direction_blend_colour("d").alias("c")).collect()
    assert [r["s"] for r in got] == ["N", "N", "E", "S", "N", None]
    assert got[0]["c"] == "#3366e5"  # pure north: weight 1 -> the north colour itself
    assert got[2]["c"] == "#ffffff" and got[4]["c"] == "#ffffff" and got[5]["c"] == "#ffffff"


def test_parse_date_coerces(spark):
    df = spark.createDataFrame([("02-29T13:00:00",), ("02-30T01:00:00",), ("junk",)], "DATE string")
    got = [r[0] for r in df.select(fs.parse_normals_date("DATE").cast("timestamp_ntz")).collect()]
    assert got == [dt.datetime(2000, 2, 29, 13), None, None]


def test_make_date_safe(spark):
    df = spark.createDataFrame([(2024, 2, 29), (2023, 2, 29), (2024, 13, 1)], "y int, m int, d int")
    assert [r[0] for r in df.select(fs.make_date_safe("y", "m", "d")).collect()] == [dt.date(2024, 2, 29), None, None]


# ---- windows ---------------------------------------------------------------------------------------------
def _series(spark):
    t0 = dt.datetime(2024, 1, 1)
    data = [("s1", t0 + dt.timedelta(hours=h), v) for h, v in enumerate([1.0, None, 4.0, 10.0, 2.0])]
    data += [("s2", t0, 7.0)]  # one-row station
    return spark.createDataFrame(data, "station string, time timestamp_ntz, x double")


def test_rolling_and_lags_match_pandas(spark):
    df = _series(spark)
    w = temporal.station_window()
    out = df.withColumns({"m": temporal.rolling_mean("x", w), "s": temporal.rolling_std("x", w),
                          "d": F.col("x") - F.lag("x", 1).over(w)}).orderBy("station", "time").toPandas()
    pdf = df.toPandas().sort_values(["station", "time"])
    g = pdf.groupby("station")["x"]
    exp_m = g.rolling(3, min_periods=1).mean().reset_index(0, drop=True)
    exp_s = g.rolling(3, min_periods=1).std().reset_index(0, drop=True).fillna(0)
    exp_d = g.diff()
    np.testing.assert_allclose(out["m"].to_numpy(dtype=float), exp_m.to_numpy(), equal_nan=True)
    np.testing.assert_allclose(out["s"].to_numpy(dtype=float), exp_s.to_numpy(), equal_nan=True)
    np.testing.assert_allclose(out["d"].to_numpy(dtype=float), exp_d.to_numpy(), equal_nan=True)


def test_lag_block_struct_equals_single_lags(spark):
    df = _series(spark).withColumn("y", F.col("x") * 2)
    w = temporal.station_window()
    a = temporal.lag_block(df, ["x", "y"], [1, 2], w)
    b = df.withColumns({f"{c}_lag{k}": F.lag(c, k).over(w) for k in (1, 2) for c in ("x", "y")})
    cols = ["station", "time", "x_lag1", "y_lag1", "x_lag2", "y_lag2"]
    assert sorted(rows(a, *cols), key=str) == sorted(rows(b, *cols), key=str)


def test_sequence_index_equals_row_number(spark):
    rnd = random.Random(3)
    t0 = dt.datetime(2024, 1, 1)
    data = [("hot" if i % 3 else f"s{i % 7}", t0 + dt.timedelta(minutes=rnd.randint(0, 60 * 24 * 20)), float(i))
            for i in range(600)]
    df = spark.createDataFrame(data, "station string, time timestamp_ntz, x double").dropDuplicates(["station", "time"])
    a = temporal.sequence_index(df, "station", "time")
    w = temporal.station_window()
    b = df.withColumn("seq", F.row_number().over(w) - 1)
    assert sorted(rows(a, "station", "time", "seq")) == sorted(rows(b, "station", "time", "seq"))


def test_time_folds_match_timeseriessplit_layout(spark):
    t0 = dt.datetime(2024, 1, 1)
    n = 1234
    df = spark.createDataFrame([("s", t0 + dt.timedelta(hours=i)) for i in range(n)], "station string, time timestamp_ntz")
    f = temporal.time_folds(df, "station", ["time"]).toPandas()
    k = min(5, max(2, n // 500))
    size = n // (k + 1)
    for i in range(k):
        test_lo = n - (k - i) * size
        fi = f[f.fold == i]
        assert set(fi[fi.role == "test"].row_index) == set(range(test_lo, test_lo + size))
        assert set(fi[fi.role == "train"].row_index) == set(range(0, test_lo))


# ---- spatial -----------------------------------------------------------------------------------------------
def _brute_knn(places, stations, k):
    out = {}
    for pid, plat, plon in places:
        d = []
        for sid, slat, slon in stations:
            p1, p2 = math.radians(plat), math.radians(slat)
            a = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(slon - plon) / 2) ** 2
            d.append((2 * 6371.0 * math.asin(math.sqrt(min(1.0, a))), sid))
        out[pid] = [s for _, s in sorted(d)[:k]]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_k_nearest_exact_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    # a dense cluster, a sparse world, poles and the antimeridian
    stations = [(i, rnd.uniform(40, 42), rnd.uniform(-75, -73)) for i in range(60)]
    stations += [(100 + i, rnd.uniform(-89.9, 89.9), rnd.uniform(-180, 180)) for i in range(40)]
    stations += [(200, 89.95, 10.0), (201, -89.95, -170.0), (202, 0.0, 179.99), (203, 0.0, -179.99)]
    places = [(i, rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for i in range(40)]
    places += [(50, 41.0, -74.0), (51, 0.0, 180.0), (52, 90.0, 0.0), (53, -90.0, 0.0)]
    st = spark.createDataFrame(stations, "station long, latitude double, longitude double")
    pl = spark.createDataFrame(places, "place long, latitude double, longitude double")
    got = k_nearest(pl, st, 4, place_key="place").toPandas()
    exp = _brute_knn(places, stations, 4)
    for pid, ids in exp.items():
        g = got[got.place == pid].sort_values("rank")
        assert list(g.station) == ids, pid
        assert list(g["rank"]) == [1, 2, 3, 4]


def test_k_nearest_fewer_stations_than_k(spark):
    st = spark.createDataFrame([(1, 10.0, 10.0), (2, -10.0, -10.0)], "station long, latitude double, longitude double")
    pl = spark.createDataFrame([(1, 0.0, 0.0)], "place long, latitude double, longitude double")
    got = k_nearest(pl, st, 5, place_key="place").collect()
    assert sorted(r["station"] for r in got) == [1, 2]


def test_haversine_known_distance(spark):
    r = spark.range(1).select(haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))).first()[0]
    assert r == pytest.approx(2 * math.pi * 6371.0 / 360, rel=1e-9)


# ---- event window (J5) -------------------------------------------------------------------------------------
def test_event_window_equals_theta_join(spark):
    rnd = random.Random(5)
    t0 = dt.datetime(2024, 1, 1)
    obs = spark.createDataFrame([(rnd.randint(0, 4), t0 + dt.timedelta(minutes=rnd.randint(0, 60 * 24 * 40)))
                                 for _ in range(3000)], "station long, time timestamp_ntz")
    ev = spark.createDataFrame([(i, rnd.randint(0, 4), dt.date(2024, 1, 1) + dt.timedelta(days=rnd.randint(0, 39)))
                                for i in range(50)], "ev long, station long, d date")
    a = temporal.event_window_join(ev, obs, days=3)
    lo = F.col("d").cast("timestamp_ntz") - F.expr("INTERVAL 3 DAYS")
    hi = F.col("d").cast("timestamp_ntz") + F.expr("INTERVAL 3 DAYS")
    b = ev.join(obs, "station").filter(F.col("time").between(lo, hi))
    assert sorted(rows(a, "ev", "time")) == sorted(rows(b, "ev", "time"))
    plan = a._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_date_spine_only_for_places_without_rows(spark):
    places = spark.createDataFrame([("a",), ("b",)], "city string")
    data = spark.createDataFrame([("a", dt.date(2024, 1, 1), 1.0)], "city string, date date, v double")
    sp = temporal.date_spine(places, data, ["city"], "2024-01-01", "2024-01-03", {"v": "double"}).collect()
    assert sorted((r["city"], r["date"]) for r in sp) == [("b", dt.date(2024, 1, d)) for d in (1, 2, 3)]


# ---- reshaping, selections, sampling ---------------------------------------------------------------------
def test_pivot_unpivot_roundtrip(spark):
    df = spark.createDataFrame([("t", r, float(r), float(-r)) for r in (1, 2, 3)], "time string, rank int, u double, v double")
    p = reshape.pivot_ranks(df, ["time"], "rank", [1, 2, 3], ["u", "v"])
    assert set(p.columns) == {"time", "u_1", "v_1", "u_2", "v_2", "u_3", "v_3"}
    long = reshape.unpivot(p, ["time"], [f"u_{r}" for r in (1, 2, 3)], "k", "u")
    assert sorted(r["u"] for r in long.collect()) == [1.0, 2.0, 3.0]


def test_align_and_drop_empty(spark):
    import pyspark.sql.types as T
    df = spark.createDataFrame([(1.0,)], "a double")
    schema = T.StructType([T.StructField("a", T.DoubleType()), T.StructField("b", T.DoubleType())])
    al = reshape.align_schema(df, schema)
    assert al.columns == ["a", "b"]
    assert reshape.drop_all_null_columns(al).columns == ["a"]


def test_drop_matching_and_rename(spark):
    df = spark.createDataFrame([(1, "x", 2)], "`HLY-TEMP-NORMAL` int, `HLY-TEMP-NORMAL_ATTRIBUTES` string, k int")
    d = reshape.rename(reshape.drop_matching(df, "_ATTRIBUTES"), {"HLY-TEMP-NORMAL": "temp", "absent": "z"})
    assert d.columns == ["temp", "k"]


def test_selections(spark):
    df = spark.createDataFrame([("A", 1.0, 0.0, 0.0), ("B", 5.0, 10.0, 10.0), ("C", None, 1.0, 1.0)],
                               "r string, s double, x double, y double")
    assert df.filter(selection.point_selection("r", [])).count() == 3  # empty set selects all
    assert df.filter(selection.point_selection("r", ["A", "C"])).count() == 2
    assert df.filter(selection.interval_selection("s", 1.0, 5.0)).count() == 2
    assert df.filter(selection.box_selection("x", "y", (0, 2), (0, 2))).count() == 2
    flags = [r["selected"] for r in selection.highlight(df, selection.interval_selection("s", 0, 2)).collect()]
    assert flags == [True, False, False]


def test_hash_split_is_partition_independent(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    a = sampling.split_by_hash(df.repartition(1), "k")
    b = sampling.split_by_hash(df.repartition(13), "k")
    assert sorted(rows(a, "k", "split")) == sorted(rows(b, "k", "split"))
    share = a.filter("split = 'train'").count() / 2000
    assert 0.75 < share < 0.85


def test_stratified_sample_counts(spark):
    df = spark.createDataFrame([(i, i % 5) for i in range(200)] + [(1000, 4)], "ev long, magnitude int")
    s = sampling.stratified_sample(df, "magnitude", [4], 5, key="ev").toPandas()
    assert (s.magnitude == 4).sum() == 41
    for m in range(4):
        assert (s.magnitude == m).sum() == 5


def test_reindex_keeps_missing_keys(spark):
    data = spark.createDataFrame([("Summer", 1.0)], "season string, v double")
    order = spark.createDataFrame([(s, i) for i, s in enumerate(fs.SEASON_ORDER)], "season string, position int")
    out = rows(reindex(data, order, "season"), "season", "v")
    assert out == [("Spring", None), ("Summer", 1.0), ("Fall", None), ("Winter", None)]


# ---- metrics ---------------------------------------------------------------------------------------------
def test_confusion_rows_sum_to_100(spark):
    df = spark.createDataFrame([("Clear", "Clear"), ("Clear", "Rain"), ("Rain", "Rain"), ("Snow", None)],
                               "t string, p string")
    cm = mx.confusion_percent(df, ["Clear", "Cloudy", "Rain", "Snow"], "t", "p").toPandas()
    assert len(cm) == 16
    sums = cm.groupby("true_label").percentage.sum()
    assert sums["Clear"] == pytest.approx(100) and sums["Rain"] == pytest.approx(100) and sums["Snow"] == 0
    assert set(cm[cm.true_label == "Clear"].text) == {"50.0%", "0.0%"}


def test_regression_metrics_match_numpy(spark):
    rnd = np.random.default_rng(0)
    y = rnd.normal(size=200)
    p = y + rnd.normal(scale=0.3, size=200)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "p": p}))
    m = mx.regression_metrics(df, [("y", "p")]).first()
    r2 = 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert m["r2"] == pytest.approx(r2) and m["mae"] == pytest.approx(np.abs(y - p).mean())
    assert m["rmse"] == pytest.approx(np.sqrt(((y - p) ** 2).mean()))


def test_circular_r2_zero_when_constant(spark):
    df = spark.createDataFrame([(90.0, 80.0), (90.0, 100.0)], "a double, p double")
    assert mx.circular_r2(df, "a", "p").first()["circular_r2"] == 0.0


# ---- plan shape ------------------------------------------------------------------------------------------------
def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_station_windows_share_one_exchange(spark, smoke_dir):
    from windlass.plans import features as fx
    from windlass.sources import standins as sv
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = _plan(fx.diff_roll(sv.obs(spark, smoke_dir)))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # the rows and the tails of the pieces by (station, day), the tails by station
    assert plan.count("Exchange hashpartitioning") == 3
    assert "SinglePartition" not in plan


def test_filters_and_columns_reach_the_scan(spark, smoke_dir):
    from windlass.sources import standins as sv
    o = sv.obs(spark, smoke_dir).filter(F.col("time") >= F.lit("2024-01-10").cast("timestamp_ntz")).select("station", "wspd")
    plan = o._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters:"):]
    assert "GreaterThanOrEqual(ts,2024-01-10T00:00)" in pushed.split("]")[0]
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,value:double>" in plan


# ---- a station with most of the rows ---------------------------------------------------------------------
def _hot_series(spark):
    rnd = random.Random(11)
    t0 = dt.datetime(2024, 1, 1)
    data = []
    for i in range(3000):
        st = 0 if i % 3 else 1 + i % 5  # station 0 holds two thirds of the rows
        data.append((st, t0 + dt.timedelta(minutes=7 * i + rnd.randint(0, 5)), (None if rnd.random() < 0.03 else rnd.uniform(-5, 30)),
                     rnd.uniform(-10, 20), rnd.uniform(0, 100), rnd.uniform(0, 359), rnd.uniform(0, 60),
                     rnd.uniform(980, 1030), rnd.randint(1, 27)))
    return spark.createDataFrame(data, "station long, time timestamp_ntz, temp double, dwpt double, rhum double, "
                                       "wdir double, wspd double, pres double, coco int")


def test_derived_names_match_formulas(spark):
    from windlass.plans import features as fx
    g = {k: 0.0 for k in ("pres_mean", "temp_mean", "pres_q10", "wspd_q90", "temp_q10", "temp_q90")}
    assert list(fx.derived_columns(g).keys()) == fx.DERIVED


def test_running_id_consecutive_in_order(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), (F.col("id") % 13).alias("g")).repartition(7)
    out = temporal.running_id(df, [F.col("g").asc(), F.col("k").asc()], "rid").toPandas()
    exp = out.sort_values(["g", "k"]).reset_index(drop=True)
    assert list(exp.rid) == list(range(5000))


def _sorted_quantile(vals, p):
    s, x = sorted(vals), (len(vals) - 1) * p
    lo, hi = math.floor(x), math.ceil(x)
    return s[lo] if lo == hi else (hi - x) * s[lo] + (x - lo) * s[hi]


def test_quantiles_equal_a_full_sort_at_every_spread(spark):
    rng = np.random.default_rng(3)
    groups = {"normal": rng.normal(size=3001), "wide": rng.normal(size=800) * 10.0 ** rng.integers(-200, 200, 800),
              "outlier": np.append(rng.random(500), 1e308), "dense": 1 + rng.random(700) * 1e-9, "ties": rng.integers(-2, 3, 400) / 2,
              "powers": np.concatenate([s * 2.0 ** np.arange(-60, 60) * f for s in (1, -1) for f in (1, 1 - 1e-16, 1 + 3e-16)]),
              "one": np.array([7.5]), "tiny": np.array([0.0, 5e-324, -5e-324, 1e-301, -1e-301, 1e-299])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [(None, 1.0), (None, 4.0), ("normal", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(7)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 0.95, 1.0]
    got = {r["g"]: r["quantiles"] for r in quantiles.grouped_quantiles(df, ["g"], "x", probs).collect()}
    groups[None] = np.array([1.0, 4.0])
    assert got == {g: [_sorted_quantile(vs.tolist(), p) for p in probs] for g, vs in groups.items()}
    assert quantiles.global_quantiles(df.filter("g = 'none'"), "x", [0.5]) == [None]
    np.testing.assert_allclose(got["normal"], np.quantile(groups["normal"], probs), rtol=1e-12)


def test_quantiles_of_a_million_values_inside_one_range(spark):
    """All values lie in one range of the first cut; no window of the finer cuts sees more than 2^14 rows of them."""
    df = spark.range(1_000_000).select((F.lit(1.0) + F.col("id") * F.lit(2.0 ** -36)).alias("x"))
    assert df.select(quantiles.value_range(F.col("x")).alias("r")).distinct().count() == 1
    probs = [0.0, 0.1, 0.5, 0.999, 1.0]
    got = quantiles.global_quantiles(df.repartition(8), "x", probs)
    v = 1.0 + np.arange(1_000_000) * 2.0 ** -36
    assert got == [_sorted_quantile(v, p) if 0 < p < 1 else float(v[0 if p == 0 else -1]) for p in probs]


@pytest.mark.parametrize("most", [1, 5])
def test_quantiles_by_every_cut(spark, monkeypatch, most):
    monkeypatch.setattr(quantiles, "MOST_VALUES", most)
    rng = np.random.default_rng(3)
    groups = {"dense": 1 + rng.random(400) * 1e-11, "normal": rng.normal(size=500), "ties": rng.integers(-2, 3, 300) / 2, "signs": np.array([-0.5, 0.5] * 40)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, x double").repartition(5)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r["g"]: r["quantiles"] for r in quantiles.grouped_quantiles(df, ["g"], "x", probs).collect()}
    assert got == {g: [_sorted_quantile(vs.tolist(), p) for p in probs] for g, vs in groups.items()}


def test_value_range_never_decreases(spark):
    rng = np.random.default_rng(5)
    vals = np.concatenate([rng.normal(size=2000) * 10.0 ** rng.integers(-300, 300, 2000), 2.0 ** np.arange(-1074.0, 1024),
                           np.nextafter(2.0 ** np.arange(-1000.0, 1024), 0), [0.0, -0.0, np.inf, -np.inf, 1.7976931348623157e308]])
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    got = [r["r"] for r in df.select("x", quantiles.value_range(F.col("x")).alias("r")).orderBy("x").collect()]
    assert got == sorted(got)


def test_k_nearest_plan_has_no_nested_loop(spark):
    st = spark.createDataFrame([(i, 40.0 + i * 0.1, -80.0 + i * 0.1) for i in range(30)],
                               "station long, latitude double, longitude double")
    pl = spark.createDataFrame([(i, 40.05 + i * 0.1, -79.95) for i in range(10)],
                               "place long, latitude double, longitude double")
    plan = k_nearest(pl, st, 3, place_key="place")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("leaf_stations", [None, 1, 3])
def test_k_nearest_across_the_antimeridian_and_at_the_poles(spark, leaf_stations):
    from windlass.operators.spatial import EARTH_RADIUS_KM, k_nearest
    rng = np.random.default_rng(3)
    st = [(0, 0.0, 170.0), (1, 0.0, -166.0), (2, 88.0, 10.0), (3, -89.0, -170.0)] + [
        (4 + i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-90, 90, 12), rng.uniform(-180, 180, 12)))]
    pl = [(0, 0.0, -179.9), (1, 0.0, 179.9), (2, 89.5, -170.0), (3, -90.0, 0.0), (4, 10.0, 180.0), (5, 10.0, -180.0)] + [
        (6 + i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-90, 90, 20), rng.uniform(170, 190, 20)))]
    pl = [(k, a, b - 360 if b > 180 else b) for k, a, b in pl]
    got = k_nearest(spark.createDataFrame(pl, "place int, latitude double, longitude double"),
                    spark.createDataFrame(st, "station int, latitude double, longitude double"), 3, leaf_stations=leaf_stations)
    got = {(r["place"], r["rank"]): r["distance_km"] for r in got.collect()}
    for k, a, b in pl:
        p1, p2 = np.radians(a), np.radians([s[1] for s in st])
        x = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians([s[2] - b for s in st]) / 2) ** 2
        want = np.sort(2 * EARTH_RADIUS_KM * np.arcsin(np.sqrt(x)))[:3]
        assert np.allclose([got[k, r] for r in (1, 2, 3)], want, rtol=1e-9)


def test_tornado_data_keeps_one_row_per_track_and_hour(spark):
    from datetime import date, datetime, timedelta

    from windlass.plans import reports
    tracks = spark.createDataFrame([(7, "TX", 4, 30.0, -99.0, 2024, date(2024, 5, 2)), (7, "OK", 4, 35.0, -97.0, 2024, date(2024, 5, 2))],
                                   ["Tornado Number", "State Abbreviation", "Magnitude", "Starting Latitude", "Starting Longitude", "Year", "event_date"])
    st = spark.createDataFrame([(1, 30.1, -99.0), (2, 35.1, -97.0)], ["station", "latitude", "longitude"])
    obs = spark.createDataFrame([(s, datetime(2024, 5, 1) + timedelta(hours=h), 5.0, 90.0) for s in (1, 2) for h in range(24)],
                                "station long, time timestamp_ntz, wspd double, wdir double")
    got = reports.tornado_data(tracks, st, obs).collect()
    assert len(got) == 48 and len({(r["state"], r["time"]) for r in got}) == 48


def test_regional_daily_wind_counts_the_whole_last_day(spark):
    from datetime import datetime

    from windlass.plans import reports
    places = spark.createDataFrame([("A", "r", 30.0, -99.0), ("B", "r", 50.0, 10.0)], ["city", "region", "latitude", "longitude"])
    st = spark.createDataFrame([(1, 30.0, -99.0), (2, 50.0, 10.0)], ["station", "latitude", "longitude"])
    obs = spark.createDataFrame([(1, datetime(2024, 12, 31, h), float(h), 0.0) for h in range(24)],
                                "station long, time timestamp_ntz, wspd double, wdir double")
    got = reports.regional_daily_wind(obs, st, places, "2024-12-31", "2024-12-31", factor=1.0).collect()
    assert [(str(r["date"]), r["wspd_mph"]) for r in got] == [("2024-12-31", 11.5)]
