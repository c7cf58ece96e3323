"""Mergeable daily state (A1-A3, A5-A7, A10, S5): partial results per (station, day) that add up to any range and place.

For each measure a state row holds n, sum, minimum, maximum and the sum of squared deviations from its mean, for the direction
n and the sums of sine and cosine, and if asked a KLL sketch of the measure. ``merge`` adds states up to any keys and
gives a state again; ``finish`` turns a state into means, deviations, circular means and quantiles. Reports over months then read one
row a station and day instead of every observation, and a new day is one more partition of the stored table.

All partial results combine map-side, so a hot station or place costs what any other does. Sums of squares are merged around the merged mean.
Quantiles from sketches are approximate (``SKETCH_K`` sets their size); exact ones need the observations (``operators.quantiles``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windlass.functions.circular import to_0_360
from windlass.sources.files import write_table

SKETCH_K = 400


def daily_state(obs: DataFrame, measures: Sequence[str] = ("wspd",), direction: str | None = "wdir", sketches: Sequence[str] = (),
                keys: Sequence[str] = ("station",), time: str = "time") -> DataFrame:
    """One row per key and day. Rows without a time have no day and are left out; a null key is a key of its own."""
    aggs = []
    for m in measures:
        aggs += [F.count(m).alias(f"{m}_n"), F.sum(F.col(m).cast("double")).alias(f"{m}_sum"), F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max"),
                 (F.var_pop(m) * F.count(m)).alias(f"{m}_m2")]
    aggs += [F.kll_sketch_agg_double(F.col(m).cast("double"), F.lit(SKETCH_K)).alias(f"{m}_kll") for m in sketches]
    if direction:
        rad = F.radians(direction)
        aggs += [F.count(direction).alias(f"{direction}_n"), F.sum(F.sin(rad)).alias(f"{direction}_sin"), F.sum(F.cos(rad)).alias(f"{direction}_cos")]
    return obs.filter(F.col(time).isNotNull()).groupBy(*keys, F.to_date(time).alias("date")).agg(*aggs)


def _fields(state: DataFrame, suffix: str) -> list[str]:
    return [c[:-len(suffix)] for c in state.columns if c.endswith(suffix)]


def merge(state: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    """The state of each of ``keys`` (columns of ``state`` or of what was joined to it)."""
    aggs = []
    for m in _fields(state, "_m2"):
        n, total = F.sum(f"{m}_n"), F.sum(f"{m}_sum")
        squares = F.sum(F.col(f"{m}_m2") + F.try_divide(F.col(f"{m}_sum") * F.col(f"{m}_sum"), F.col(f"{m}_n")))
        aggs += [n.alias(f"{m}_n"), total.alias(f"{m}_sum"), F.min(f"{m}_min").alias(f"{m}_min"), F.max(f"{m}_max").alias(f"{m}_max"),
                 F.greatest(F.lit(0.0), squares - F.try_divide(total * total, n)).alias(f"{m}_m2")]
    aggs += [F.kll_merge_agg_double(f"{m}_kll", F.lit(SKETCH_K)).alias(f"{m}_kll") for m in _fields(state, "_kll")]
    for d in _fields(state, "_sin"):
        aggs += [F.sum(f"{d}_{x}").alias(f"{d}_{x}") for x in ("n", "sin", "cos")]
    return state.groupBy(*keys).agg(*aggs)


def mean_of_state(m: str) -> Column:
    return F.try_divide(F.col(f"{m}_sum"), F.col(f"{m}_n"))


def std_of_state(m: str) -> Column:
    """Sample standard deviation; null below two values."""
    return F.when(F.col(f"{m}_n") > 1, F.sqrt(F.col(f"{m}_m2") / (F.col(f"{m}_n") - 1)))


def direction_of_state(d: str) -> Column:
    """Circular mean in degrees; null without a direction."""
    n = F.col(f"{d}_n")
    return F.when(n > 0, to_0_360(F.degrees(F.atan2(F.col(f"{d}_sin") / n, F.col(f"{d}_cos") / n))))


def quantiles_of_state(m: str, probs: Sequence[float]) -> Column:
    """Approximate quantiles from the sketch; null without values."""
    return F.when(F.col(f"{m}_n") > 0, F.array(*[F.kll_sketch_get_quantile_double(f"{m}_kll", F.lit(float(p))) for p in probs]))


def write_daily_state(state: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store a state by month, so a range of days reads its months only; ``append`` adds days (a day may come in parts)."""
    write_table(state.withColumn("month", F.date_trunc("month", "date").cast("date")), path, ["month"], mode)


def read_daily_state(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """The stored rows of the days in [start, end]."""
    state = spark.read.parquet(path)
    if start is not None:
        state = state.filter((F.col("month") >= F.date_trunc("month", F.lit(start).cast("date")).cast("date")) & (F.col("date") >= F.lit(start).cast("date")))
    if end is not None:
        state = state.filter((F.col("month") <= F.lit(end).cast("date")) & (F.col("date") <= F.lit(end).cast("date")))
    return state.drop("month")
