"""Spatial operators: great-circle distance and the exact k-nearest-station join.

k nearest without a cross join: stations lie in the leaves of a quadtree over latitude and longitude whose cells are split until they hold
few stations (``operators.quadtree``), so a dense city has small cells and an empty ocean one large cell. The
tree's directory (leaf, count, box) is small and bounded. Each place gets from it a distance within which k stations must lie, and the
leaves that come that close; an equi-join on the leaf brings their stations, and a top-k per place ranks them. That is one search for
all places, at every density, without levels or checkpoints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windlass.operators.joins import maybe_broadcast
from windlass.operators.quadtree import leaf_of, near_leaves, quad_key, station_leaves

EARTH_RADIUS_KM = 6371.0


def haversine_km(lat1, lon1, lat2, lon2, radius: float = EARTH_RADIUS_KM) -> Column:
    def c(x):
        return F.col(x) if isinstance(x, str) else x
    p1, p2 = F.radians(c(lat1)), F.radians(c(lat2))
    dp = p2 - p1
    dl = F.radians(c(lon2)) - F.radians(c(lon1))
    a = F.pow(F.sin(dp / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), 2)
    return F.lit(2 * radius) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def k_nearest(places: DataFrame, stations: DataFrame, k: int, place_key: str = "place",
              station_key: str = "station", place_lat: str = "latitude", place_lon: str = "longitude",
              station_lat: str = "latitude", station_lon: str = "longitude", leaf_stations: int | None = None,
              radius: float = EARTH_RADIUS_KM) -> DataFrame:
    """J4 + W7: for each place its ``k`` nearest stations, ranked 1..k by (distance, station key).

    Returns the place columns plus ``station_key``, ``distance_km`` and ``rank``. The search runs once per distinct (lat, lon).
    ``leaf_stations`` is the number of stations from which a cell is split. ``place_key`` is kept for callers' clarity; places and stations
    without coordinates get no rows.
    """
    known = stations.filter(F.col(station_lat).isNotNull() & F.col(station_lon).isNotNull() & ~F.isnan(station_lat) & ~F.isnan(station_lon))
    st = known.select(F.col(station_key).alias("__sid"), F.col(station_lat).alias("__slat"), F.col(station_lon).alias("__slon"))
    # of stations at one point, only the k smallest keys can be among the k nearest of anything
    at_point = Window.partitionBy("__slat", "__slon").orderBy("__sid")
    st = st.withColumn("__nth", F.row_number().over(at_point)).filter(F.col("__nth") <= k).drop("__nth")
    st = st.withColumn("__key", quad_key("__slat", "__slon"))
    leaves = station_leaves(st.select("__key"), leaf_stations or max(64, 4 * k))
    st = maybe_broadcast(st.withColumn("__leaf", leaf_of(leaves)("__key")).drop("__key"), known_rows=leaves.stations)
    key = ["__plat", "__plon"]
    points = places.select(F.col(place_lat).cast("double").alias("__plat"), F.col(place_lon).cast("double").alias("__plon"))
    points = points.filter(F.col("__plat").isNotNull() & F.col("__plon").isNotNull() & ~F.isnan("__plat") & ~F.isnan("__plon")).distinct()
    cand = near_leaves(points, leaves, k).join(st, "__leaf").withColumn(
        "distance_km", haversine_km("__plat", "__plon", "__slat", "__slon", radius))
    w = Window.partitionBy(*key).orderBy(F.col("distance_km").asc(), F.col("__sid").asc())
    out = cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    out = out.select(*key, F.col("__sid").alias(station_key), "distance_km", "rank")
    # back to the places: equi-join on the exact coordinates
    pl = places.withColumns({"__plat": F.col(place_lat).cast("double"), "__plon": F.col(place_lon).cast("double")})
    return pl.join(out, key).drop(*key)
