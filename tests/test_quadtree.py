"""Adaptive quadtree and the k-nearest search on it, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from windlass.operators import quadtree
from windlass.operators.spatial import EARTH_RADIUS_KM, k_nearest


def kilometres(lat, lon, lats, lons):
    p1, p2 = np.radians(lat), np.radians(lats)
    a = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lons - lon) / 2) ** 2
    return 2 * EARTH_RADIUS_KM * np.arcsin(np.sqrt(np.minimum(1, a)))


def brute(places, stations, k):
    lats, lons = np.array([s[1] for s in stations]), np.array([s[2] for s in stations])
    out = set()
    for p, lat, lon in places:
        d = np.round(kilometres(lat, lon, lats, lons), 9)
        best = sorted(zip(d.tolist(), [s[0] for s in stations]))[:k]
        out |= {(p, s, r + 1) for r, (_, s) in enumerate(best)}
    return out


@pytest.fixture(scope="module")
def world():
    """Half of the stations stand in one city; some share a point, some stand at the poles and the date line."""
    rng = np.random.default_rng(8)
    city = [(40.7 + a, -74.0 + b) for a, b in rng.normal(0, 0.05, (1500, 2))]
    wide = list(zip(np.degrees(np.arcsin(rng.uniform(-1, 1, 1400))), rng.uniform(-180, 180, 1400)))
    odd = [(90.0, 0.0), (-90.0, 10.0), (10.0, 180.0), (10.0, -180.0), (0.0, 179.999)] + [(51.5, -0.1)] * 60
    stations = [(i, float(a), float(b)) for i, (a, b) in enumerate(city + wide + odd)]
    near = [(40.7 + a, -74.0 + b) for a, b in rng.normal(0, 0.2, (60, 2))]
    places = near + list(zip(rng.uniform(-90, 90, 60), rng.uniform(-180, 180, 60))) + odd[:6] + [(40.7, -74.0), (0.0, -30.0)]
    return stations, [(i, float(a), float(b)) for i, (a, b) in enumerate(places)]


def frames(spark, world):
    stations, places = world
    return (spark.createDataFrame(stations, "station int, latitude double, longitude double").repartition(5),
            spark.createDataFrame(places, "place int, latitude double, longitude double").repartition(3))


@pytest.mark.parametrize("k,leaf", [(1, 1), (3, 16), (7, None), (70, 8)])
def test_k_nearest_is_brute_force_with_half_the_stations_in_a_city(spark, world, k, leaf):
    st, pl = frames(spark, world)
    got = k_nearest(pl, st, k, leaf_stations=leaf)
    rows = got.collect()
    assert got.columns == ["place", "latitude", "longitude", "station", "distance_km", "rank"]
    want = brute(world[1], world[0], k)
    by_rank = {(r["place"], r["rank"]): (r["station"], r["distance_km"]) for r in rows}
    assert len(rows) == len(want) == len(by_rank)
    where = {s: (a, b) for s, a, b in world[0]}
    at = {p: (a, b) for p, a, b in world[1]}
    for p, s, r in want:  # distances that differ by less than a rounding may be ranked either way
        own, km = by_rank[p, r]
        assert own == s or abs(km - kilometres(*at[p], np.array([where[s][0]]), np.array([where[s][1]]))[0]) < 1e-6


def test_leaves_adapt_and_partition_the_stations(spark, world):
    st, _ = frames(spark, world)
    keys = st.select(quadtree.quad_key("latitude", "longitude").alias("key"), "station", "latitude", "longitude")
    leaves = quadtree.station_leaves(keys.select("key"), 32)
    assert leaves.stations == len(world[0]) and (np.diff(leaves.starts) > 0).all()
    rows = keys.withColumn("leaf", quadtree.leaf_of(leaves)("key")).collect()
    counts = np.bincount([r["leaf"] for r in rows], minlength=len(leaves.counts))
    assert (counts == leaves.counts).all()
    points = {}
    for r in rows:
        points.setdefault(r["leaf"], set()).add((r["latitude"], r["longitude"]))
    assert all(n <= 32 or len(points[i]) == 1 for i, n in enumerate(leaves.counts))
    for r in rows:  # a leaf's box holds its stations
        la, lo = np.radians(r["latitude"]), np.radians(r["longitude"])
        xyz = np.array([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)])
        assert (xyz >= leaves.low[r["leaf"]] - 1e-9).all() and (xyz <= leaves.high[r["leaf"]] + 1e-9).all()


def test_the_search_is_one_job_and_no_loop(spark, world):
    st, pl = frames(spark, world)
    plan = k_nearest(pl, st, 3)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert "WindowGroupLimit" in plan


def test_missing_coordinates_and_little(spark, world):
    st, pl = frames(spark, world)
    odd = spark.createDataFrame([(1, None, 2.0), (2, float("nan"), 2.0), (3, 95.0, 10.0), (4, 5.0, 370.0)], "place int, latitude double, longitude double")
    got = k_nearest(odd, st, 1).collect()
    same = k_nearest(spark.createDataFrame([(3, 85.0, -170.0), (4, 5.0, 10.0)], odd.schema), st, 1).collect()
    assert sorted((r["place"], r["station"]) for r in got) == sorted((r["place"], r["station"]) for r in same)
    assert k_nearest(pl, st.limit(0), 2).count() == 0 and k_nearest(pl.limit(0), st, 2).count() == 0
    assert k_nearest(pl, st.limit(2), 5).count() == 2 * len(world[1])
    nowhere = st.limit(1).withColumn("latitude", F.lit(None).cast("double"))
    assert k_nearest(pl, nowhere, 2).count() == 0
