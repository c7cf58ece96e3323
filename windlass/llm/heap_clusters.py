"""Centroid clustering with heap-ordered bounds (exact k-means rounds on integer vectors).

A vector's gap is the distance to its second nearest centroid less that to its own. After a round no vector of
cluster a can have lost more gap than the way that centroid a moved and the longest way that another one moved;
these losses are added up per cluster (its drift). A cluster's heap holds its vectors by gap + drift at the time of
entry: those on top whose key is no more than the drift now have no gap left. Only they are popped, compared
exactly with all centroids, and pushed to the heap of the cluster that they belong to. All others provably stay.

Scale: vectors lie in blocks of ``BLOCK`` rows in the smallest integer type that holds them. A block is one row, with its
heaps and its count and componentwise sum for each cluster, of which a round changes the parts of popped vectors
only. Rounds write the blocks to the shared folder, so a lost executor costs a re-read. Each round's sums and the centroids
(k rows) pass the driver; nothing else does.

Exactness: vectors, sums, centroids and squared distances are integers. Bounds are square roots in double
precision, rounded towards expiry; a gap of zero (a tie) always counts as expired if its cluster's bound moved at all, so
ties go to the smaller number as in a full comparison.

Defined cases: vectors that are null, not of ``dims`` components, or hold null or non-finite components are left out, as
are those with a component of ``LIMIT`` or more after scaling (their squared distance does not fit in 64 bits). Repeated
rows are vectors of their own. A null vec_id is kept; it comes last where ids are hashed. Equal hashes
(repeated ids) stand in the order of their components. With fewer vectors than centroids each vector starts one. An empty
table gives an empty result. Labels and other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from windlass.llm.common import saved

BLOCK, LIMIT = 4096, 2 ** 27
STATE = "ids binary, vectors binary, width int, clusters binary, heaps array<binary>, counts binary, sums binary, rescanned long"


def integer_vectors(rows: DataFrame, dims: int, scale: float) -> DataFrame:
    """vec_id and v (array of long): the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    usable = rows.select(F.col("vec_id").cast("long"), v.alias("v")).filter(F.size("v") == dims).filter(
        F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * scale < LIMIT)))
    return usable.select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest hash of their id, in that order (a top-k)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(digest.asc_nulls_last(), "v").limit(k).select("v").collect()
    return np.array([r[0] for r in rows], np.int64)


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, a row per vector and a column per centroid."""
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster of each vector (the smaller number on ties) and a lower bound of its gap."""
    d = squared(x, centroids)
    own = d.argmin(1)
    if d.shape[1] == 1:
        return own, np.full(len(x), np.inf)
    two = np.sqrt(np.partition(d, 1, axis=1)[:, :2].astype(np.float64))
    return own, (two[:, 1] - two[:, 0]) - 1e-12 * two[:, 1]


def packed(heap: list) -> bytes:
    return np.array(heap, np.dtype([("key", "<f8"), ("row", "<i4")])).tobytes()


def unpacked(raw: bytes) -> list:
    return np.frombuffer(raw, np.dtype([("key", "<f8"), ("row", "<i4")])).tolist()


def state_row(ids: bytes, x: np.ndarray, own: np.ndarray, heaps: list, counts: np.ndarray, sums: np.ndarray, rescanned: int) -> tuple:
    most = int(np.abs(x).max(initial=0))
    small = x.astype(np.int8 if most < 2 ** 7 else np.int16 if most < 2 ** 15 else np.int32)
    return (ids, small.tobytes(), small.itemsize, own.astype(np.int32).tobytes(), [packed(h) for h in heaps], counts.tobytes(), sums.tobytes(), rescanned)


def vectors_in(raw: bytes, width: int, dims: int) -> np.ndarray:
    return np.frombuffer(raw, f"<i{width}").reshape(-1, dims).astype(np.int64)


def first_state(vectors: DataFrame, centroids: np.ndarray, dims: int) -> DataFrame:
    """Blocks whose vectors have all been compared once."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def build(frames):
        centroids = shared.value
        for frame in frames:
            out = []
            for a in range(0, len(frame), BLOCK):
                part = frame.iloc[a:a + BLOCK]
                x = np.array(part["v"].tolist(), np.int64).reshape(-1, dims)
                own, gap = nearest(x, centroids)
                heaps: list = [[] for _ in centroids]
                for row, (c, g) in enumerate(zip(own.tolist(), gap.tolist())):
                    heaps[c].append((g, row))
                for h in heaps:
                    heapq.heapify(h)
                sums = np.zeros((len(centroids), dims), np.int64)
                np.add.at(sums, own, x)
                ids = part["vec_id"].astype("Int64")
                flags = ids.isna().to_numpy(np.uint8).tobytes()
                out.append(state_row(ids.fillna(0).to_numpy(np.int64).tobytes() + flags, x, own, heaps, np.bincount(own, minlength=len(centroids)), sums, len(x)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in STATE.split(", ")])

    return vectors.mapInPandas(build, STATE)


def next_state(state: DataFrame, centroids: np.ndarray, drift: np.ndarray, dims: int) -> DataFrame:
    """Blocks after a round: expired vectors popped, compared with all centroids, and pushed again."""
    shared = state.sparkSession.sparkContext.broadcast((centroids, drift))

    def turn(frames):
        centroids, drift = shared.value
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                x, own = vectors_in(r.vectors, r.width, dims), np.frombuffer(r.clusters, np.int32).copy()
                heaps, expired = [unpacked(h) for h in r.heaps], []
                for c, heap in enumerate(heaps):
                    while heap and heap[0][0] <= drift[c]:
                        expired.append(heapq.heappop(heap)[1])
                counts, sums = np.frombuffer(r.counts, np.int64).copy(), np.frombuffer(r.sums, np.int64).reshape(-1, dims).copy()
                if expired:
                    rows = np.array(expired)
                    new, gap = nearest(x[rows], centroids)
                    moved = new != own[rows]
                    for sign, of in ((-1, own[rows][moved]), (1, new[moved])):
                        np.add.at(sums, of, sign * x[rows][moved])
                        np.add.at(counts, of, sign)
                    own[rows] = new
                    for row, c, g in zip(expired, new.tolist(), gap.tolist()):
                        heapq.heappush(heaps[c], (g + float(drift[c]), row))
                out.append(state_row(r.ids, x, own, heaps, counts, sums, len(expired)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in STATE.split(", ")])

    return state.mapInPandas(turn, STATE)


def totals(state: DataFrame, k: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Members and componentwise sums of each cluster, exact: k rows."""
    def partial(frames):
        for frame in frames:
            for counts, sums in zip(frame["counts"], frame["sums"]):
                sums = np.frombuffer(sums, np.int64).reshape(k, dims)
                yield pd.DataFrame({"cluster": range(k), "n": np.frombuffer(counts, np.int64), "sums": sums.tolist()})

    rows = (state.select("counts", "sums").mapInPandas(partial, "cluster int, n long, sums array<long>").groupBy("cluster")
            .agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dims)]).collect())
    n, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
    for r in rows:
        n[r["cluster"]], sums[r["cluster"]] = r["n"], [r[f"s{i}"] for i in range(dims)]
    return n, sums


def clusters(rows: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, dims: int = 64, scale: float = 64.0):
    """(state, centroids): every vector's block after the last assignment, and the final centroids. None without vectors."""
    vectors = saved(integer_vectors(rows, dims, scale), "vectors")
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return None
    state = saved(first_state(vectors, centroids, dims), "blocks")
    drift = np.zeros(len(centroids))
    for _ in range(rounds):
        n, sums = totals(state, len(centroids), dims)
        before, centroids = centroids, np.where(n[:, None] > 0, sums // np.maximum(n, 1)[:, None], centroids)
        way = np.sqrt(((centroids - before) ** 2).sum(1).astype(np.float64)) * (1 + 1e-12)
        others = np.array([np.delete(way, c).max(initial=0) for c in range(len(way))])
        drift = (drift + way + others) * (1 + 1e-12)
        state = saved(next_state(state, centroids, drift, dims), "blocks")
    return state, centroids


def cluster_vectors(rows: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, dims: int = 64, scale: float = 64.0) -> DataFrame:
    """One row per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = rows.sparkSession
    found = clusters(rows, k, rounds, seed, dims, scale)
    if found is None:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    state, centroids = found
    shared = spark.sparkContext.broadcast(centroids)

    def distances(frames):
        for frame in frames:
            for r in frame.itertuples(index=False):
                x, own = vectors_in(r.vectors, r.width, dims), np.frombuffer(r.clusters, np.int32)
                ids, missing = np.frombuffer(r.ids[:8 * len(x)], np.int64), np.frombuffer(r.ids[8 * len(x):], np.uint8) > 0
                yield pd.DataFrame({"vec_id": pd.arrays.IntegerArray(ids.copy(), missing), "cluster": own, "distance": ((x - shared.value[own]) ** 2).sum(1)})

    each = saved(state.select("ids", "vectors", "width", "clusters").mapInPandas(distances, "vec_id long, cluster int, distance long"), "distances")
    digests = [(c, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids.tolist())]
    wide = F.col("distance").cast("decimal(38,0)")
    per = each.groupBy("cluster").agg(F.sum(wide).alias("cluster_inertia"))  # k rows
    per = per.withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy()))
    per = per.join(F.broadcast(spark.createDataFrame(digests, "cluster int, centroid_sha256 string")), "cluster")
    out = each.join(F.broadcast(per), "cluster")
    return out.select("vec_id", "cluster", "distance", *[F.col(c).try_cast("long").alias(c) for c in ("cluster_inertia", "inertia")], "centroid_sha256")


def _round_sql(n: int) -> str:
    return f"""
near{n} AS (
  SELECT vec_id, nth, v, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance
  FROM (SELECT k.vec_id, k.nth, k.v, c.cluster, list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(k.v, c.v)])::BIGINT AS d FROM kept k, cent{n} c)
  GROUP BY vec_id, nth, v),"""


def _update_sql(n: int) -> str:
    return f"""
cent{n} AS (
  SELECT c.cluster, coalesce(s.v, c.v) AS v FROM cent{n - 1} c LEFT JOIN (
    SELECT cluster, list(m ORDER BY i) AS v FROM (
      SELECT cluster, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS m
      FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM near{n - 1}) GROUP BY cluster, i) GROUP BY cluster) s USING (cluster)),"""


SQL = f"""
WITH kept AS (
  SELECT vec_id, row_number() OVER () AS nth, [floor(x::DOUBLE * 64)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x) AND abs(x::DOUBLE) * 64 < 134217728]) = 64),
cent0 AS (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS cluster, v
  FROM (SELECT v, sha256('1:' || vec_id::VARCHAR) AS h FROM kept ORDER BY h NULLS LAST, v LIMIT 16)),
{_round_sql(0)}{_update_sql(1)}{_round_sql(1)}{_update_sql(2)}{_round_sql(2)}{_update_sql(3)}{_round_sql(3)}
digest AS (SELECT cluster, sha256(array_to_string(v, ',')) AS centroid_sha256 FROM cent3)
SELECT vec_id, cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM near3 JOIN digest USING (cluster)
"""
