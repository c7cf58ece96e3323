"""Grouped and global aggregations.

All grouped statistics are built-in aggregates. Algebraic ones (avg, sum, count, min, max,
stddev, the sin/cos means of a direction) combine map-side, so a hot group costs no more
than any other. Exact quantiles come from ``operators.quantiles`` (one method at every size);
``approx=True`` asks for the bounded-memory sketch instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windlass.functions.circular import circular_mean
from windlass.operators.quantiles import global_quantiles_many, grouped_quantiles


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def quantile(col, p: float, approx: bool = False, accuracy: int = 10000) -> Column:
    """Linear-interpolated quantile (pandas/NumPy default) as an aggregate; ``approx`` uses the sketch. The exact
    form keeps a map of a group's distinct values in one task: for few distinct values, else ``grouped_quantiles``."""
    if approx:
        return F.percentile_approx(_c(col), p, accuracy)
    return F.percentile(_c(col), F.lit(p))


def round_doubles(df: DataFrame, digits: int | None) -> DataFrame:
    """Half-even rounding of every double column as pandas/NumPy do it (``rint(x*10^d)/10^d``,
    plain double arithmetic inside codegen); ``+ 0.0`` turns a negative zero into 0.0 so equal
    results hash alike."""
    if digits is None:
        return df
    from windlass.functions.scalar import round_half_even
    return df.select(*[(round_half_even(F.col(f.name), digits) + F.lit(0.0)).alias(f.name)
                       if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields])


def wind_profile(obs: DataFrame, keys: Sequence[str], speed: str = "wspd", direction: str = "wdir",
                 q: float = 0.95, approx: bool = False) -> DataFrame:
    """A3: mean, q-quantile, max, sample std of speed and circular mean of direction per group."""
    ks = [f"__g{i}" for i in range(len(keys))]
    stats = obs.groupBy(*[F.col(k).alias(g) for k, g in zip(keys, ks)]).agg(
        F.avg(speed).alias("avg_wind_speed_kmh"),
        F.max(speed).alias("max_wind_speed_kmh"),
        F.stddev_samp(speed).alias("wind_speed_std_kmh"),
        circular_mean(direction).alias("avg_wind_direction_deg"),
        *([quantile(speed, q, approx=True).alias("wind_speed_95th_kmh")] if approx else []),
    )
    own = [F.col(g).alias(k) for g, k in zip(ks, keys)]
    order = ["avg_wind_speed_kmh", "wind_speed_95th_kmh", "max_wind_speed_kmh", "wind_speed_std_kmh", "avg_wind_direction_deg"]
    if approx:
        return stats.select(*own, *order)
    exact = grouped_quantiles(obs, keys, speed, [q], "__q")
    same = F.lit(True)
    for k, g in zip(keys, ks):
        same = same & F.col(k).eqNullSafe(F.col(g))
    joined = stats.join(exact, same, "left").withColumn("wind_speed_95th_kmh", F.col("__q")[0])
    return joined.select(*own, *order)


def wind_mean(obs: DataFrame, keys: Sequence[str], speed: str = "wspd", direction: str = "wdir") -> DataFrame:
    """A1 + A2: mean speed and circular mean direction per group."""
    return obs.groupBy(*keys).agg(
        F.avg(speed).alias("avg_wind_speed_kmh"),
        circular_mean(direction).alias("avg_wind_direction_deg"),
    )


def mean_by(df: DataFrame, keys: Sequence[str], cols: Sequence[str], suffix: str = "") -> DataFrame:
    """Mean of several columns per group (null keys dropped, as pandas does)."""
    src = df.dropna(subset=list(keys)) if keys else df
    return src.groupBy(*keys).agg(*[F.avg(c).alias(f"{c}{suffix}") for c in cols])


def min_mean_max(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """A5: min, mean and max of one column per group."""
    src = df.dropna(subset=list(keys))
    return src.groupBy(*keys).agg(F.min(col).alias("min"), F.avg(col).alias("mean"), F.max(col).alias("max"))


def describe(df: DataFrame, cols: Sequence[str], digits: int | None = 2) -> DataFrame:
    """A4: pandas-style ``describe`` (count, mean, std, min, 25%, 50%, 75%, max) as rows.

    One aggregation pass computes every other statistic of every column; the single result row is
    then unpivoted.
    """
    # quartiles: exact, of all columns at once, entered as literals
    simple = [("count", lambda c: F.count(c).cast("double")), ("mean", F.avg), ("std", F.stddev_samp),
              ("min", lambda c: F.min(c).cast("double")), ("max", lambda c: F.max(c).cast("double"))]
    aggs = [fn(F.col(c)).alias(f"{name}__{c}") for name, fn in simple for c in cols]
    quarts = global_quantiles_many(df, {c: [0.25, 0.5, 0.75] for c in cols})
    aggs += [F.array(*[F.lit(v).cast("double") for v in quarts[c]]).alias(f"q__{c}") for c in cols]
    wide = df.agg(*aggs)
    order = ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]
    quart = {"25%": 1, "50%": 2, "75%": 3}
    pieces = []
    for i, name in enumerate(order):
        vals = [(F.element_at(F.col(f"q__{c}"), quart[name]) if name in quart else F.col(f"{name}__{c}")).alias(c)
                for c in cols]
        pieces.append(F.struct(F.lit(name).alias("statistic"), F.lit(i).alias("position"), *vals))
    out = wide.select(F.inline(F.array(*pieces)))
    return round_doubles(out, digits)


def global_scalars(df: DataFrame, exprs: dict[str, Column]) -> dict[str, float]:
    """A handful of global statistics as driver-side constants.

    One partial+final aggregation returns a single row of fixed width; its values are then
    used as literals in later row expressions. This avoids both an un-partitioned window
    (all rows in one task) and a cross join against a one-row table.
    """
    row = df.agg(*[e.alias(k) for k, e in exprs.items()]).first()
    return {k: row[k] for k in exprs}


def value_share(df: DataFrame, col: str, count_name: str = "count", share_name: str = "percent") -> DataFrame:
    """A9 + W6: value counts (nulls excluded) and their share of the total in percent."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(count_name))
    total = global_scalars(counts, {"t": F.sum(count_name)})["t"] or 0
    return counts.withColumn(share_name, F.try_divide(F.col(count_name) * F.lit(100.0), F.lit(float(total))))


def share_within(df: DataFrame, group: Sequence[str], value: str, share_name: str = "percent") -> DataFrame:
    """Value as percent of its group's total. Runs on an already aggregated (small) table."""
    from pyspark.sql import Window
    w = Window.partitionBy(*group)
    return df.withColumn(share_name, F.try_divide(F.col(value) * F.lit(100.0), F.sum(value).over(w)))


def padded_domain(df: DataFrame, col: str, mode: str = "plus2") -> tuple[float, float]:
    """Scale domain of a column: [0, max+2], min/max +-5 % of range, or +-1.2*max."""
    s = global_scalars(df, {"lo": F.min(col), "hi": F.max(col)})
    lo, hi = s["lo"], s["hi"]
    if lo is None:
        return (None, None)
    if mode == "plus2":
        return (0.0, hi + 2)
    if mode == "range5":
        pad = (hi - lo) * 0.05
        return (lo - pad, hi + pad)
    if mode == "sym12":
        return (-hi * 1.2, hi * 1.2)
    return (lo, hi)


def first_by_order(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Keep one row per key -- the first by an explicit order (pandas keeps the first)."""
    from pyspark.sql import Window
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def shape(df: DataFrame) -> tuple[int, int]:
    """(rows, columns)."""
    return df.count(), len(df.columns)
