"""An adaptive quadtree of points on the globe, as a small directory.

A point's quad key interleaves the bits of its latitude and longitude, ``DEPTH`` of each; the first 2m bits are its cell at
level m. A cell with more than ``most`` points is split, so the leaves are small where points are dense. Counts of
all cells come from one aggregation, and only the leaves (first key, points, level) reach the driver. Their number is bounded:
``most`` grows where the points are more than ``MAX_LEAVES`` times as many.

Bounds are taken between points and boxes in three dimensions (points of the unit sphere), where a chord is shorter
exactly if its great circle is; so the date line and the poles are like any other place.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEPTH, MAX_LEAVES, SLACK = 20, 32_768, 1e-9
#: Masks that spread the bits of a number to every second place (Morton order).
SPREAD = [(16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)]


def _spread(x: Column) -> Column:
    for shift, mask in SPREAD:
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def quad_key(lat: str, lon: str) -> Column:
    """The quad key of a point; angles beyond the usual ranges are those of the same point of the sphere."""
    la, lo = F.radians(lat), F.radians(lon)
    x, y, z = F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la)
    side = 1 << DEPTH

    def place(degrees: Column, half: float) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(side - 1), F.floor((degrees + half) / (2 * half) * side))).cast("long")

    north = place(F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z)))), 90.0)
    east = place(F.degrees(F.atan2(y, x)), 180.0)
    return F.shiftleft(_spread(north), 1).bitwiseOR(_spread(east))


@dataclass
class Leaves:
    """Leaves in key order: their first keys, numbers of points, and boxes (low and high corner) on the unit sphere."""

    spark: SparkSession
    starts: np.ndarray
    counts: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @property
    def stations(self) -> int:
        return int(self.counts.sum())


def boxes(starts: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The boxes around cells. From level 2 on a cell lies between two right angles, so its corners hold the extremes."""
    bits = (starts[:, None] >> np.arange(2 * DEPTH)) & 1
    east, north = ((bits[:, o::2] << np.arange(DEPTH)).sum(1) for o in (0, 1))
    size = 2.0 ** -levels.astype(np.float64)
    south = np.radians(north / 2.0 ** DEPTH * 180 - 90)
    west = np.radians(east / 2.0 ** DEPTH * 360 - 180)
    up, right = south + np.radians(180 * size), west + np.radians(360 * size)
    flat = np.stack([np.cos(south), np.cos(up)])
    z = np.sort(np.stack([np.sin(south), np.sin(up)]), 0)
    x, y = (np.stack([c * f(lon) for c in flat for lon in (west, right)]) for f in (np.cos, np.sin))
    low, high = np.stack([x.min(0), y.min(0), z[0]], 1), np.stack([x.max(0), y.max(0), z[1]], 1)
    low[levels < 2], high[levels < 2] = -1.0, 1.0
    return low, high


def station_leaves(keys: DataFrame, most: int) -> Leaves:
    """The leaves of a table with one column of quad keys. One count and one aggregation; leaves reach the driver."""
    name, spark = keys.columns[0], keys.sparkSession
    total = keys.count()
    most = max(most, -(-4 * DEPTH * total // MAX_LEAVES)) if total > MAX_LEAVES * most // 8 else most
    cells = keys.select(F.explode(F.sequence(F.lit(0), F.lit(DEPTH))).alias("level"), name)
    cells = cells.select("level", F.expr(f"shiftright({name}, 2 * ({DEPTH} - level))").alias("cell"))
    counts = cells.groupBy("level", "cell").agg(F.count(F.lit(1)).alias("n"))
    split = counts.filter((F.col("n") > most) & (F.col("level") < DEPTH)).select((F.col("level") + 1).alias("level"), F.col("cell").alias("parent"))
    small = counts.filter((F.col("n") <= most) | (F.col("level") == DEPTH)).withColumn("parent", F.shiftright("cell", 2))
    leaves = small.filter("level > 0").join(split, ["level", "parent"]).select("level", "cell", "n")
    rows = leaves.unionByName(small.filter("level = 0").select("level", "cell", "n")).collect()
    level = np.array([r["level"] for r in rows], np.int64)
    starts = np.array([r["cell"] for r in rows], np.int64) << (2 * (DEPTH - level))
    order = np.argsort(starts)
    low, high = boxes(starts[order], level[order])
    return Leaves(spark, starts[order], np.array([r["n"] for r in rows], np.int64)[order], low, high)


def leaf_of(leaves: Leaves) -> Callable[[str], Column]:
    """The number of the leaf of a quad key of the table."""
    shared = leaves.spark.sparkContext.broadcast(leaves.starts)

    @F.pandas_udf("int")
    def find(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shared.value, key.to_numpy(np.int64), "right") - 1, dtype="int32")

    return find


def reached(points: np.ndarray, low: np.ndarray, high: np.ndarray, counts: np.ndarray, k: int) -> list[np.ndarray]:
    """For each point of the sphere, the leaves that may hold one of its k nearest."""
    gap = np.maximum(0, np.maximum(low[None] - points[:, None], points[:, None] - high[None]))
    nearest = np.sqrt((gap * gap).sum(2))
    far = np.maximum(np.abs(points[:, None] - low[None]), np.abs(points[:, None] - high[None]))
    farthest = np.sqrt((far * far).sum(2))
    order = np.argsort(farthest, 1)
    enough = np.cumsum(counts[order], 1) >= k
    last = np.where(enough.any(1), enough.argmax(1), -1)
    within = np.where(last >= 0, np.take_along_axis(farthest, order, 1)[np.arange(len(points)), last], np.inf)
    return [np.flatnonzero(row <= limit + SLACK) for row, limit in zip(nearest, within)]


def near_leaves(points: DataFrame, leaves: Leaves, k: int) -> DataFrame:
    """The rows of ``points`` (latitude, longitude), once for each leaf that may hold one of the k nearest, as ``__leaf``."""
    lat, lon = points.columns
    shared = leaves.spark.sparkContext.broadcast((leaves.low, leaves.high, leaves.counts))

    def search(frames):
        low, high, counts = shared.value
        step = max(1, 500_000 // max(1, len(counts)))
        for frame in frames:
            for a in range(0, len(frame) if len(counts) else 0, step):
                part = frame.iloc[a:a + step]
                la, lo = np.radians(part[lat].to_numpy()), np.radians(part[lon].to_numpy())
                xyz = np.stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)], 1)
                found = reached(xyz, low, high, counts, k)
                n = [len(f) for f in found]
                yield pd.DataFrame({lat: np.repeat(part[lat].to_numpy(), n), lon: np.repeat(part[lon].to_numpy(), n),
                                    "__leaf": np.concatenate(found).astype(np.int32)})

    return points.mapInPandas(search, f"`{lat}` double, `{lon}` double, __leaf int")
