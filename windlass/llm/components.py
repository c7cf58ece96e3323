"""Connected components of a link table, by alternating large-star and small-star rounds.

A link table has long columns ``a`` and ``b``. Every round is two joins with the smallest neighbour; minima are
aggregated map-side and written before the join, so both sides of the join are plain exchanges and AQE can split
a node with very many links. Rounds are written to the shared folder and end as soon as the links are stars, which
one small aggregation tells; nothing else reaches the driver.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windlass.llm.common import saved


def forest(pairs) -> list[tuple[int, int]]:
    """(node, smallest node reached) of each node but the smallest: union-find over ``pairs``."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root.setdefault(top, top) != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return [(x, find(x)) for x in root if find(x) != x]


def _local_stars(frames):
    """Each batch's links as stars: the same components with fewer, shorter links."""
    for frame in frames:
        yield pd.DataFrame(forest(zip(frame["a"].tolist(), frame["b"].tolist())), columns=["a", "b"], dtype="int64")


def are_stars(edges: DataFrame) -> bool:
    """Every node ``a`` has one link only and is no other node's ``b``: nothing is left to contract."""
    ends = (edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
            .unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))))
    at = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return at.filter((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("down") == 1))).isEmpty()


def components(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, component): each linked node with the smallest node of its component. Every link of the rounds leads
    from ``a`` to a smaller ``b``, so the centre of a star is its smallest node."""
    edges = saved(links.filter("a <> b").mapInPandas(_local_stars, "a long, b long").distinct(), "links")
    for _ in range(most_rounds):
        if are_stars(edges):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = saved(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least")), "least")
        large = saved(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
                      .filter("a <> b").distinct(), "large")
        least = saved(large.groupBy("a").agg(F.min("b").alias("least")), "least")
        small = (large.join(least, "a").select(F.when(F.col("b") == F.col("least"), F.col("a")).otherwise(F.col("b")).alias("a"),
                                               F.col("least").alias("b")).distinct())
        edges = saved(small, "links")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
