"""Palette, arrows, unions of mains, rejected rows of file sources, and the public reports on places without data."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from windlass.functions.scalar import SPEED_PALETTE, palette_mix
from windlass.operators.reshape import drop_any_null
from windlass.plans import model_queries as mq
from windlass.plans import reports
from windlass.plans.wind import with_speed_scale
from windlass.sources import files


def test_palette_mix(spark):
    stops = ["#000000", "#ff8000", "#ffffff", "#0000ff"]

    def want(x):
        x = min(1.0, max(0.0, x)) * 3
        i = min(int(x), 2)
        rgb = [[int(s[k:k + 2], 16) for k in (1, 3, 5)] for s in stops]
        return "#" + "".join(f"{round(a + (x - i) * (b - a)):02x}" for a, b in zip(rgb[i], rgb[i + 1]))

    xs = [-1.0, 0.0, 0.1, 1 / 3, 0.5, 2 / 3, 0.9, 1.0, 7.0]
    df = spark.createDataFrame([(x,) for x in xs] + [(None,), (float("nan"),)], "x double")
    got = [r["c"] for r in df.select(palette_mix("x", stops).alias("c")).collect()]
    assert got == [want(x) for x in xs] + [None, None]
    one = spark.createDataFrame([(0.3,)], "x double").select(palette_mix("x", ["#102030"]).alias("c")).first()["c"]
    assert one == "#102030"


def test_speed_scale_has_domain_and_end_colours(spark):
    t = spark.createDataFrame([("a", 2.0), ("b", 8.0), ("c", None)], "city string, s double")
    got = {r["city"]: r for r in with_speed_scale(t, "s").collect()}
    assert (got["a"]["domain_min"], got["a"]["domain_max"]) == (2.0, 8.0)
    assert (got["a"]["speed_colour"], got["b"]["speed_colour"], got["c"]["speed_colour"]) == (SPEED_PALETTE[0], SPEED_PALETTE[-1], None)
    flat = with_speed_scale(t.filter("city = 'a'"), "s").first()
    assert flat["speed_position"] is None and flat["speed_colour"] is None


def test_arrows_take_one_place_in_order_or_all(spark):
    t0 = datetime(2024, 1, 1)
    pred = spark.createDataFrame([(s, t0 + timedelta(hours=h), 1.0, 2.0, 3.0, 4.0) for s in (2, 1) for h in (1, 0)],
                                 "station int, time timestamp_ntz, u_obs double, v_obs double, u_pred double, v_pred double")
    st = spark.createDataFrame([(1, 20.0, 5.0), (1, 10.0, 9.0), (1, 10.0, 4.0), (2, 0.0, 0.0)], "station int, longitude double, latitude double")
    one = mq.prediction_arrows(pred, st.repartition(3)).orderBy("arrow_id").collect()
    assert [(r["station"], r["time"].hour, r["longitude"], r["latitude"], r["arrow_id"]) for r in one] == [
        (1, 0, 10.0, 4.0, 0), (1, 1, 10.0, 4.0, 1), (2, 0, 0.0, 0.0, 2), (2, 1, 0.0, 0.0, 3)]
    every = mq.prediction_arrows(pred, st, keep_repeats=True)
    assert every.count() == 8 and sorted(r["arrow_id"] for r in every.collect()) == list(range(8))
    assert mq.pick_id(every, "arrow_id", 7).first()["station"] == 2


def test_wind_vectors_by_the_hour_and_union_of_mains(spark):
    t0 = datetime(2024, 1, 1)
    st = spark.createDataFrame([(i, 40.0 + i, -80.0) for i in range(4)], "station long, latitude double, longitude double")
    obs = spark.createDataFrame([(i, t0 + timedelta(minutes=30 * h), float(h + i), 270.0) for i in range(4) for h in range(4)],
                                "station long, time timestamp_ntz, wspd double, wdir double")
    got = mq.wind_vector_table(obs, st, st.filter("station = 0"), k=2).orderBy("time").collect()
    assert [r["time"] for r in got] == [t0, t0 + timedelta(hours=1)]
    assert [r["u_1"] for r in got] == pytest.approx([0.5, 2.5]) and [r["u_2"] for r in got] == pytest.approx([1.5, 3.5])
    both = mq.wind_vector_union(obs, st, [st.filter("station < 3"), st.filter("station > 0")], k=2)
    assert both.count() == 8 and both.select("station", "time").distinct().count() == 8


def test_drop_any_null(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, 1.0), (3, "c", 2.0)], "i int, s string, x double")
    assert [r["i"] for r in drop_any_null(df).collect()] == [3]
    assert sorted(r["i"] for r in drop_any_null(df, ["s"]).collect()) == [1, 3]


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_rejected_rows_have_a_reason_and_a_file(spark, tmp_path):
    head = "Year,Tornado Number,State Abbreviation,Month,Day,Time,Magnitude,Starting Latitude,Starting Longitude,Ending Latitude,Ending Longitude"
    a = write(tmp_path / "a.csv", head, "2024,1,OK,5,6,15:00:00,4,35.1,-97.4,35.2,-97.3", "2024,x2,KS,5,6,10:00:00,high,38.0,-97.0,38.1,-96.9",
              "2024,3,TX,1,1", "2024,4,TX,1,1,10:00:00,,30.0,-97.0,30.1,-96.9", "2024,5,TX,1,1,10:00:00,1,30.0,-97.0,30.1,-96.9,extra,more")
    b = write(tmp_path / "b.csv", head, "2023,9,IA,2,3,01:00:00,0,41.0,-93.0,41.0,-93.0")
    gone = str(tmp_path / "gone.csv")
    q = files.read_csv_quarantined(spark, [a, b, gone], files.TRACK_TYPES)
    assert sorted(r["Tornado Number"] for r in q.clean.collect()) == [1, 4, 9]
    assert dict(q.clean.dtypes)["Magnitude"] == "int" and q.clean.filter("Magnitude IS NULL").count() == 1
    rejected = {(r["file"].rsplit("/", 1)[-1], r["reason"]): r["line"] for r in q.rejected.collect()}
    assert set(rejected) == {("a.csv", "not a value of its type: Tornado Number, Magnitude"), ("a.csv", "wrong number of fields"), ("gone.csv", "missing file")}
    assert "x2" in rejected["a.csv", "not a value of its type: Tornado Number, Magnitude"]
    counts = {r["file"].rsplit("/", 1)[-1]: (r["clean_rows"], r["rejected_rows"]) for r in q.counts.collect()}
    assert counts == {"a.csv": (2, 3), "b.csv": (1, 0), "gone.csv": (0, 1)}
    none = files.read_csv_quarantined(spark, gone, files.TRACK_TYPES)
    assert none.clean.count() == 0 and set(none.clean.columns) == set(files.TRACK_TYPES) and none.rejected.count() == 1


def test_reports_of_places_without_data(spark):
    """A place whose station has no observation keeps a row of nulls, and null days."""
    places = spark.createDataFrame([("A", "r", 30.0, -99.0), ("B", "q", 50.0, 10.0)], ["city", "region", "latitude", "longitude"])
    st = spark.createDataFrame([(1, 30.0, -99.0), (2, 50.0, 10.0)], ["station", "latitude", "longitude"])
    obs = spark.createDataFrame([(1, datetime(2024, 1, 1, h), float(h), 90.0) for h in range(24)], "station long, time timestamp_ntz, wspd double, wdir double")
    stats = {r["city"]: r for r in reports.wind_stats(obs, st, places).collect()}
    assert stats["A"]["avg_wind_speed_kmh"] == 11.5 and stats["B"]["avg_wind_speed_kmh"] is None and stats["B"]["avg_wind_direction_deg"] is None
    table = reports.wind_table(obs, st, places).collect()
    assert {"domain_min", "domain_max", "speed_colour"} <= set(table[0].asDict())
    daily = {(r["Region"], str(r["date"])): r["wspd_mph"] for r in reports.regional_daily_wind(obs, st, places, "2024-01-01", "2024-01-02", factor=1.0).collect()}
    assert daily == {("r", "2024-01-01"): 11.5, ("q", "2024-01-01"): None, ("q", "2024-01-02"): None}
    tables = reports.wind_tables(obs, st, places, groups=(("r",), ("q",)))
    assert [[r["city"] for r in t.collect()] for t in tables] == [["A"], ["B"]]
    hourly = reports.hourly_wind(obs, st, places, "2024-01-01", "2024-01-02")
    per_day, top = reports.cities_map_data(hourly, factor=1.0)
    assert hourly.count() == 24 and [(r["city"], r["day_of_year"], r["wind_speed"]) for r in per_day.collect()] == [("A", 1, 11.5)] and top == 13.5
    features = spark.createDataFrame([("A", "coast")], "city string, feature string")
    dash = {r["city"]: r["geographic_feature"] for r in reports.dashboard_std_data(obs, st, places, features).collect()}
    assert dash == {"A": "coast", "B": "Standard"}
    temps = reports.geo_feature_temperature(obs.withColumn("temp", F.lit(10.0)), st, spark.createDataFrame([("lake", 30.0, -99.0), ("dune", 50.0, 10.0)],
                                            "feature string, latitude double, longitude double"), "2024-01-01", "2024-01-01").collect()
    assert {(r["Feature"], r["temp_f"]) for r in temps} == {("lake", 50.0), ("dune", None)}
