"""Interval joins of events and observations, safe from hot keys.

An event covers a time interval at a key (a station); it joins the observations of that key inside the interval. Time is cut into
blocks: an event stands in each block that it touches, an observation in one, so (key, block) is an equi-join and the exact bounds are
checked on its rows. A bucket with more than ``hot_rows`` events or observations is salted: its events are dealt into as many parts as
they exceed the bound, and so are its observations; each part of one side meets each part of the other, so
every pair still meets once and no task holds a hot bucket.

Which buckets are hot comes from counts of both sides, aggregated map-side before any row moves. The table of hot buckets is broadcast
behind a check of its size, else joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windlass.operators.joins import maybe_broadcast
from windlass.session import cut_lineage

HOT_ROWS = 50_000


def hot_buckets(events: DataFrame, obs: DataFrame, key: str, hot_rows: int) -> DataFrame:
    """(key, __block, __se, __so): parts of the events and of the observations of each bucket in which either side is hot."""
    spans = events.groupBy(key, "__first", "__last").agg(F.count(F.lit(1)).alias("n"))
    held = (spans.select(key, "n", F.explode(F.sequence("__first", "__last")).alias("__block"))
            .groupBy(key, "__block").agg(F.sum("n").alias("__e")))
    seen = obs.groupBy(key, "__block").agg(F.count(F.lit(1)).alias("__o"))
    both = held.join(seen, [key, "__block"]).filter(F.greatest("__e", "__o") > hot_rows)
    return both.select(key, "__block", F.ceil(F.col("__e") / hot_rows).alias("__se"), F.ceil(F.col("__o") / hot_rows).alias("__so"))


def _salted(rows: DataFrame, hot: DataFrame, key: str, own: str, other: str, mine: str, theirs: str) -> DataFrame:
    """``rows`` with their part of their own side, once for each part of the other side; one part where the bucket is not hot."""
    part = F.pmod(F.xxhash64(*rows.columns), F.coalesce(own, F.lit(1)))
    others = F.sequence(F.lit(0).cast("long"), F.coalesce(other, F.lit(1)) - 1)
    return (rows.join(hot, [key, "__block"], "left").withColumn(mine, part).withColumn(theirs, F.explode(others))
            .drop("__se", "__so"))


def interval_join(events: DataFrame, obs: DataFrame, key: str, start: Column, end: Column, time: str = "time",
                  block_hours: int = 12, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Pairs of an event and an observation of its ``key`` with ``time`` in [start, end] (columns of ``events``); the columns of both.
    Events with a null bound and rows with a null key or time join nothing."""
    seconds = block_hours * 3600

    def block(t: Column) -> Column:
        return F.floor(F.unix_micros(t.cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("long")

    ev = events.withColumns({"__lo": start, "__hi": end}).filter(F.col("__lo") <= F.col("__hi"))
    ev = ev.withColumns({"__first": block(F.col("__lo")), "__last": block(F.col("__hi"))})
    ob = obs.filter(F.col(time).isNotNull()).withColumn("__block", block(F.col(time)))
    hot = cut_lineage(hot_buckets(ev, ob, key, hot_rows))
    n_hot = hot.count()
    ev = ev.withColumn("__block", F.explode(F.sequence("__first", "__last"))).drop("__first", "__last")
    on = [key, "__block"]
    if n_hot:
        hot, on = maybe_broadcast(hot, known_rows=n_hot), [*on, "__pe", "__po"]
        ev = _salted(ev, hot, key, "__se", "__so", "__pe", "__po")
        ob = _salted(ob, hot, key, "__so", "__se", "__po", "__pe")
    joined = ev.join(ob, on).filter(F.col(time).between(F.col("__lo"), F.col("__hi")))
    return joined.drop("__block", "__pe", "__po", "__lo", "__hi")
