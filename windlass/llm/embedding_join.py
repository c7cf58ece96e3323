"""Embedding near-dedup: epsilon grid order join.

Vectors of length one with cosine >= c lie within eps = sqrt(2 - 2c). Distinct vectors are projected on the
leading principal axes (a projection never lengthens a distance), sorted by their eps grid cells in order of the
axes, and cut into intervals of consecutive vectors. An interval knows the box of its projections. Two intervals
whose boxes are more than eps apart are skipped; of others, the distant parts are skipped, and then every pair is
compared: a product in single precision leaves out what is below the cosine by more than its error, the rest is decided
in double precision.

Scale: copies of a vector are one vector with a count (``copies``). The number of intervals is bounded (their length grows
beyond), so the table of boxes that the tasks get is bounded. Consecutive intervals form groups of ``TILE_BYTES`` (smaller ones
where cores are left). A pair of groups is a tile, compared by one task; an interval travels to the tiles that hold an
interval near it, at most one for each group. So what is shuffled is the table times the groups, not an interval for each surviving pair,
and a task holds two groups. Of its links, a tile returns a count per vector and a spanning forest, so the output is
bounded by the members, not by the pairs.

Defined cases: null or zero vectors and vectors with null or non-finite components link with nothing; vectors of
unlike length never link; the empty vector counts as zero. Rows repeated with the same vec_id are rows of their
own in ``n_links``. A null vec_id never names a component: one of null ids only has component_id null. An empty
table gives an empty result. Labels and other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windlass.llm.common import saved
from windlass.llm.components import components

AXES, SMALL, STRIP, MAX_BLOCKS = 8, 64, 512, 16_384
#: Bytes of a group of intervals; a task holds two.
TILE_BYTES = 16 * 2 ** 20
SLACK = 1e-6


def unit(raw: bytes) -> np.ndarray:
    """Vector of length one; scaled by its largest component first, so that nothing over- or underflows."""
    x = np.frombuffer(raw, np.float64)
    x = x / np.abs(x).max()
    return x / np.sqrt((x * x).sum())


def stored(raws) -> tuple[bytes, bytes]:
    """(scales, members) of an interval: a member times its scale has length one. Single precision if it loses nothing."""
    x = np.frombuffer(b"".join(raws), np.float64).reshape(len(raws), -1)
    with np.errstate(over="ignore", under="ignore"):
        single = x.astype(np.float32)
    most = np.abs(x).max(1)
    if (single == x).all() and most.min() > 1e-30 and most.max() < 1e30:
        return (1 / np.sqrt((x * x).sum(1))).tobytes(), single.tobytes()
    return np.ones(len(raws)).tobytes(), np.array([unit(r) for r in raws]).tobytes()


def vectors_of(rows: DataFrame) -> DataFrame:
    """vec_id, raw: the components as little-endian doubles; null if the vector links with nothing."""
    def scan(frames):
        for frame in frames:
            raw = []
            for v in frame["embedding"]:
                x = None if v is None else np.array([np.nan if c is None else c for c in v], np.float64)
                raw.append(x.tobytes() if x is not None and len(x) and np.isfinite(x).all() and x.any() else None)
            yield pd.DataFrame({"vec_id": frame["vec_id"].astype("Int64"), "raw": raw})

    return (rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
            .mapInPandas(scan, "vec_id long, raw binary"))


def principal_axes(distinct: DataFrame) -> np.ndarray:
    """The leading principal axes (columns) of all vectors; shorter vectors count as ending in zeros.
    Partial sums are one matrix a task, added up in a tree."""
    most = distinct.agg(F.max(F.length("raw"))).first()[0]
    if not most:
        return np.zeros((0, AXES))
    dims = most // 8

    def partial(frames):
        total = np.zeros((dims + 1, dims + 1))
        for frame in frames:
            for i in range(0, len(frame), 4096):
                x = np.zeros((len(frame["raw"].iloc[i:i + 4096]), dims + 1))
                for row, raw in zip(x, frame["raw"].iloc[i:i + 4096]):
                    u = unit(raw)
                    row[:len(u)], row[-1] = u, 1
                total += x.T @ x
        yield pd.DataFrame({"sums": [total.tobytes()]})

    sums = distinct.select("raw").mapInPandas(partial, "sums binary").rdd.map(lambda r: np.frombuffer(r[0]))
    total = sums.treeReduce(np.add, 3).reshape(dims + 1, dims + 1)
    n, mean = total[-1, -1], total[-1, :-1] / total[-1, -1]
    axes = np.linalg.eigh(total[:-1, :-1] / n - np.outer(mean, mean))[1][:, ::-1][:, :AXES]
    return np.hstack([axes, np.zeros((dims, AXES - axes.shape[1]))])


def grid_blocks(distinct: DataFrame, axes: np.ndarray, eps: float, block: int, n: int) -> DataFrame:
    """Intervals of the grid order: block, dims, low and high (box), nodes, members."""
    shared = distinct.sparkSession.sparkContext.broadcast(axes)

    def project(frames):
        axes = shared.value
        for frame in frames:
            points = [(u := unit(raw)) @ axes[:len(u)] for raw in frame["raw"]]
            cells = [[len(raw) // 8, *np.floor(p / eps).astype(int).tolist()] for raw, p in zip(frame["raw"], points)]
            yield pd.DataFrame({"node": frame["node"], "copies": frame["copies"], "raw": frame["raw"], "cell": cells,
                                "point": [p.astype(np.float32).tobytes() for p in points]})

    def cut(frames):
        from pyspark import TaskContext

        nth, held = TaskContext.get().partitionId() << 32, []

        def rows(part):
            nonlocal nth
            out = []
            for i in range(0, len(part), block):
                nodes, copies, raws, points, _ = zip(*part[i:i + block])
                p = np.frombuffer(b"".join(points), np.float32).reshape(len(points), -1).astype(np.float64)
                out.append((nth, len(raws[0]) // 8, p.min(0).tobytes(), p.max(0).tobytes(), np.array(nodes, np.int64).tobytes(),
                            np.array(copies, np.int64).tobytes(), b"".join(points), *stored(raws)))
                nth += 1
            return pd.DataFrame(out, columns=["block", "dims", "low", "high", "nodes", "copies", "points", "scales", "members"])

        for frame in frames:
            for row in zip(frame["node"], frame["copies"], frame["raw"], frame["point"], (len(r) for r in frame["raw"])):
                if held and (held[-1][4] != row[4] or len(held) == block):  # an interval has one vector length
                    yield rows(held)
                    held = []
                held.append(row)
        if held:
            yield rows(held)

    placed = saved(distinct.select("node", "copies", "raw").mapInPandas(project, "node long, copies long, raw binary, cell array<int>, point binary"), "placed")
    return (placed.repartitionByRange(max(1, -(-n // (16 * block))), "cell", "node").sortWithinPartitions("cell", "node")
            .mapInPandas(cut, "block long, dims int, low binary, high binary, nodes binary, "
                         "copies binary, points binary, scales binary, members binary"))


def apart(low_a, high_a, low_b, high_b) -> np.ndarray:
    """Distance between boxes."""
    return np.sqrt((np.maximum(0, np.maximum(low_a - high_b, low_b - high_a)) ** 2).sum(-1))


def linked(a: np.ndarray, b: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the units with at least that cosine. Single precision only leaves out pairs that are surely below."""
    most = (a.shape[1] + 4) * 1.2e-7  # above the error of a product of units in single precision
    x, y = np.nonzero(a.astype(np.float32) @ b.astype(np.float32).T >= np.float32(cosine - most))
    if 16 * len(x) > len(a) * len(b):
        return np.nonzero(a @ b.T >= cosine)
    sure = np.einsum("ij,ij->i", a[x], b[y]) >= cosine
    return x[sure], y[sure]


def join_intervals(a: np.ndarray, b: np.ndarray, pa: np.ndarray, pb: np.ndarray, eps: float, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of linked vectors of two intervals (units and projections). Parts of ``SMALL`` vectors know their boxes;
    a part is compared with the parts near it, a strip of parts at once where nothing is distant."""
    if apart(pa.min(0), pa.max(0), pb.min(0), pb.max(0)) > eps:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    low_a, high_a, low_b, high_b = (f.reduceat(p, np.arange(0, len(p), SMALL)) for p in (pa, pb) for f in (np.minimum, np.maximum))
    found = []
    for s in range(0, len(a), STRIP):
        parts = slice(s // SMALL, (s + STRIP) // SMALL)
        near = apart(low_a[parts, None], high_a[parts, None], low_b, high_b) <= eps
        step = STRIP if near.all() else SMALL
        for i in range(s, min(s + STRIP, len(a)), step):
            at = np.flatnonzero(np.repeat(near[(i - s) // SMALL], SMALL)[:len(b)])
            if len(at):
                x, y = linked(a[i:i + step], b if len(at) == len(b) else b[at], cosine)
                found.append((x + i, at[y]))
    return tuple(np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in (0, 1))


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links (a[i], b[i]) as stars: every node but the smallest of its component, and that smallest node. Labels fall to the
    smallest neighbour's, also at the roots they point to, and are shortened, until none changes."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        for place in (x, y, label[x], label[y]):
            np.minimum.at(new, place, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def groups_of(sizes: np.ndarray, tasks: int) -> np.ndarray:
    """The group of each interval: runs of at most about ``TILE_BYTES``, and so many that their pairs keep the tasks busy."""
    least = int(np.ceil(np.sqrt(6 * tasks)))
    most = max(1.0, min(float(TILE_BYTES), sizes.sum() / least))
    return np.unique(((np.cumsum(sizes) - sizes) // most).astype(np.int64), return_inverse=True)[1]


def near_pairs(distinct: DataFrame, cosine: float = 0.9, block: int = 512) -> DataFrame:
    """Rows (a, b, weight) from the tiles: weight null for a link of the forest, else the number of
    rows that link with vector a in that tile (b is null)."""
    spark, eps = distinct.sparkSession, float(np.sqrt(2 - 2 * cosine)) + SLACK
    n = distinct.count()
    axes = principal_axes(distinct)
    block = max(block, -(-n // MAX_BLOCKS))
    blocks = saved(grid_blocks(distinct, axes, eps, block, n), "grid_blocks")
    held = ("nodes", "copies", "points", "scales", "members")
    size = sum((F.length(c) for c in held[1:]), F.length(held[0]))
    boxes = blocks.select("block", "dims", "low", "high", size.alias("size")).orderBy("block").collect()  # about MAX_BLOCKS rows of 2 x AXES numbers
    dims, ids = np.array([r["dims"] for r in boxes], np.int64), np.array([r["block"] for r in boxes], np.int64)
    low, high = (np.array([np.frombuffer(r[k]) for r in boxes]).reshape(-1, AXES) for k in ("low", "high"))
    group = groups_of(np.array([r["size"] for r in boxes], np.float64), spark.sparkContext.defaultParallelism)
    many = int(group.max(initial=-1)) + 1
    upper = spark.sparkContext.broadcast((ids, dims, low, high, group))

    def tiles(frames):
        ids, dims, low, high, group = upper.value
        for frame in frames:
            out = []
            for block, d, lo, hi in zip(frame["block"], frame["dims"], frame["low"], frame["high"]):
                own = group[np.searchsorted(ids, block)]
                near = np.unique(group[(apart(np.frombuffer(lo), np.frombuffer(hi), low, high) <= eps) & (dims == d)])
                out.append((block, own, (np.minimum(own, near) * many + np.maximum(own, near)).tolist()))
            yield pd.DataFrame(out, columns=["block", "group", "tiles"])

    def load(row):
        nodes, scales = np.frombuffer(row.nodes, np.int64), np.frombuffer(row.scales, np.float64)
        kind = np.float32 if len(row.members) == 4 * row.dims * len(nodes) else np.float64
        x = np.frombuffer(row.members, kind).reshape(len(nodes), -1).astype(np.float64) * scales[:, None]
        return x, np.frombuffer(row.points, np.float32).reshape(len(nodes), -1).astype(np.float64), np.frombuffer(row.copies, np.int64)

    def compare(tile):
        rows = list(tile.sort_values("block").itertuples(index=False))
        nodes = [np.frombuffer(r.nodes, np.int64) for r in rows]
        start = np.concatenate([[0], np.cumsum([len(x) for x in nodes])])
        low, high = (np.array([np.frombuffer(x) for x in tile.sort_values("block")[k]]) for k in ("low", "high"))
        dims, group = np.array([r.dims for r in rows]), np.array([r.group for r in rows])
        across = group[0] != group[-1]
        label, degree = np.arange(start[-1]), np.zeros(start[-1], np.int64)
        for i, row in enumerate(rows):
            near = (apart(low[i], high[i], low, high) <= eps) & (dims == row.dims) & (np.arange(len(rows)) >= i)
            if across:  # two intervals of one group are compared in that group's own tile
                near &= group != group[i]
            if not near.any():
                continue
            a, pa, ca = load(row)
            for j in np.flatnonzero(near):
                b, pb, cb = (a, pa, ca) if i == j else load(rows[j])
                x, y = join_intervals(a, b, pa, pb, eps, cosine)
                if i == j:  # each pair is found both ways here, and each vector with itself
                    x, y = x[x != y], y[x != y]
                else:
                    degree[start[j]:start[j + 1]] += np.bincount(y, ca[x], len(b)).astype(np.int64)
                degree[start[i]:start[i + 1]] += np.bincount(x, cb[y], len(a)).astype(np.int64)
                p, q = label[x + start[i]], label[y + start[j]]
                if (new := p != q).any():
                    p, q = stars(p[new], q[new])
                    least = np.arange(len(label))
                    least[p] = q
                    label = least[label]
        nodes, some, own = np.concatenate(nodes), degree > 0, label != np.arange(len(label))
        return pd.concat([pd.DataFrame({"a": nodes[some], "b": pd.array([None] * int(some.sum()), "Int64"), "weight": degree[some]}),
                          pd.DataFrame({"a": nodes[own], "b": nodes[label[own]], "weight": pd.array([None] * int(own.sum()), "Int64")})]
                         )[["a", "b", "weight"]].astype("Int64")

    placed = blocks.select("block", "dims", "low", "high").mapInPandas(tiles, "block long, group long, tiles array<long>")
    dealt = (blocks.join(F.broadcast(placed), "block").select("block", "dims", "low", "high", *held, "group", F.explode("tiles").alias("tile"))
             .repartitionByRange(max(1, many * (many + 1) // 2), "tile"))
    return dealt.groupBy("tile").applyInPandas(compare, "a long, b long, weight long")


def near_groups(rows: DataFrame, cosine: float = 0.9) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept."""
    marked = saved(vectors_of(rows), "vectors")
    usable = marked.filter("raw IS NOT NULL")
    # written at once, so a vector's node number never changes
    distinct = usable.groupBy("raw").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first_id"))
    distinct = saved(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct_vectors")
    pairs = saved(near_pairs(distinct, cosine), "near_pairs")
    degree = pairs.filter("weight IS NOT NULL").groupBy("a").agg(F.sum("weight").alias("links")).withColumnRenamed("a", "node")
    of = components(pairs.filter("weight IS NULL").select("a", "b"))
    joined = (distinct.join(degree, "node", "left").join(of, "node", "left")
              .select("raw", "copies", "first_id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component")))
    least = saved(joined.groupBy("component").agg(F.min("first_id").alias("component_id")), "least_ids")
    named = saved(joined.join(least, "component").select("raw", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id"), "named")
    linked = usable.join(named, "raw").select("vec_id", "n_links", "component_id")
    alone = marked.filter("raw IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
