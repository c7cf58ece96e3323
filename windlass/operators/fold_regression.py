"""Least squares on all expanding time folds from running sums.

A row's segment within its station tells its part in every fold: fold f trains on the segments up to f and tests on segment f + 1. So the
folds' sums are prefix sums of the segments' sums, and one scan serves all folds, without a copy of a row per fold.

The sums are Gram matrices of the row (features, flags of missing features, 1, target). They hold what mean imputation needs: the imputed
feature is x + mean * missing, linear in the row, with the mean of the fold's own training rows. Tasks return one matrix for each (folds,
segment) they meet; a few numbers per segment reach the driver, whatever the data. A second scan gives the mean absolute errors.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windlass.operators.aggregates import global_scalars
from windlass.operators.temporal import sequence_index


def fold_segments(df: DataFrame, key: str = "station", order: str = "time", tie: str | None = None, max_splits: int = 5,
                  min_splits: int = 2, rows_per_split: int = 500) -> DataFrame:
    """``df`` with ``folds`` (of its station) and ``segment``: the folds of ``temporal.time_folds``, one row each."""
    idx = sequence_index(df, key, order, name="__i", tie=tie)
    counts = df.groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("__n"))
    folds = F.least(F.lit(max_splits), F.greatest(F.lit(min_splits), F.floor(F.col("__n") / rows_per_split))).cast("int")
    counts = counts.withColumn("folds", folds).withColumn("__size", F.floor(F.col("__n") / (F.col("folds") + 1)))
    after = F.col("__i") - (F.col("__n") - F.col("folds") * F.col("__size"))
    segment = F.when((F.col("__size") == 0) | (after < 0), 0).otherwise(F.floor(after / F.greatest("__size", F.lit(1))) + 1).cast("int")
    return (idx.join(counts, F.col(key).eqNullSafe(F.col("__key"))).withColumn("segment", segment).drop("__key", "__i", "__n", "__size"))


@dataclass
class FoldFit:
    """A fold's fit: prediction = intercept + sum of weights * (feature, or its training mean where it is missing)."""

    fold: int
    weights: np.ndarray
    means: np.ndarray
    intercept: float
    train_rows: int
    test_rows: int
    r2: float
    rmse: float
    mae: float | None = None


def segment_sums(rows: DataFrame, features: Sequence[str], target: str, shift: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """The Gram matrix of each (folds, segment), of values less ``shift`` (features, then target)."""
    p = len(features)
    width = 2 * p + 2

    def partial(frames):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for frame in frames:
            x = frame[list(features)].to_numpy(np.float64)
            there = ~np.isnan(x)
            z = np.hstack([np.where(there, x - shift[:p], 0), ~there, np.ones((len(x), 1)), frame[[target]].to_numpy(np.float64) - shift[p]])
            group = frame["folds"].to_numpy(np.int64) * 64 + frame["segment"].to_numpy(np.int64)
            for g in np.unique(group):
                own = z[group == g]
                at = (int(g) // 64, int(g) % 64)
                sums[at] = sums.get(at, 0) + own.T @ own
        for (folds, segment), m in sums.items():
            yield pd.DataFrame({"folds": folds, "segment": segment, "place": np.arange(width * width), "value": m.ravel()})

    got = (rows.select("folds", "segment", *[F.col(c).cast("double").alias(c) for c in (*features, target)])
           .mapInPandas(partial, "folds int, segment int, place int, value double")
           .groupBy("folds", "segment", "place").agg(F.sum("value").alias("value")).collect())
    out: dict[tuple[int, int], np.ndarray] = {}
    for r in got:
        out.setdefault((r["folds"], r["segment"]), np.zeros(width * width))[r["place"]] = r["value"]
    return {k: v.reshape(width, width) for k, v in out.items()}


def fit_sums(train: np.ndarray, test: np.ndarray, p: int, fold: int, shift: np.ndarray) -> FoldFit:
    """The least-squares fit from the Gram matrices of a fold's training and test rows."""
    one, y = 2 * p, 2 * p + 1
    n = train[one, one]
    there = n - np.diag(train)[p:2 * p]
    means = np.where(there > 0, train[:p, one] / np.maximum(there, 1), 0.0)
    imputed = np.zeros((p + 2, 2 * p + 2))
    imputed[np.arange(p), np.arange(p)], imputed[np.arange(p), p + np.arange(p)] = 1, means
    imputed[p, one] = imputed[p + 1, y] = 1
    a, b = imputed @ train @ imputed.T, imputed @ test @ imputed.T
    centre = a[:p, p] / n
    cov = a[:p, :p] - n * np.outer(centre, centre)
    with_y = a[:p, p + 1] - centre * a[p, p + 1]
    size = np.sqrt(np.maximum(np.diag(cov), 0))
    used = size > 1e-9 * np.sqrt(np.maximum(np.diag(a)[:p], 1e-300))
    weights = np.zeros(p)
    if used.any():
        s = size[used]
        weights[used] = np.linalg.lstsq(cov[np.ix_(used, used)] / np.outer(s, s), with_y[used] / s, rcond=1e-12)[0] / s
    start = a[p, p + 1] / n - weights @ centre
    error = np.array([*weights, start, -1.0])
    m = b[p, p]
    sse = max(0.0, float(error @ b @ error))
    sst = float(b[p + 1, p + 1] - b[p, p + 1] ** 2 / m)
    return FoldFit(fold, weights, means + shift[:p], start + shift[p] - weights @ shift[:p], int(round(n)), int(round(m)),
                   1 - sse / sst if sst != 0 else 0.0, float(np.sqrt(sse / m)))


def predicted(fits: Sequence[FoldFit], features: Sequence[str], fold: Column) -> Column:
    """The prediction of the fit number ``fold`` (0 is the first of ``fits``) for a row."""
    def pick(values) -> Column:
        return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (fold + 1).cast("int"))

    out = pick([f.intercept for f in fits])
    for j, c in enumerate(features):
        out = out + pick([f.weights[j] for f in fits]) * F.coalesce(F.col(c).cast("double"), pick([f.means[j] for f in fits]))
    return out


def fold_least_squares(rows: DataFrame, features: Sequence[str], target: str) -> list[FoldFit]:
    """The fit of each expanding fold of ``rows`` (with ``folds`` and ``segment``; the target is never null): all stations' fold f
    together. Folds without training or test rows are left out."""
    p = len(features)
    held = global_scalars(rows, {f"m{i}": F.avg(c) for i, c in enumerate((*features, target))})
    shift = np.array([held[f"m{i}"] or 0.0 for i in range(p + 1)])
    sums = segment_sums(rows, features, target, shift)
    fits = []
    for f in range(max((k for k, _ in sums), default=0)):
        train = sum((m for (k, s), m in sums.items() if k > f and s <= f), np.zeros((2 * p + 2, 2 * p + 2)))
        test = sum((m for (k, s), m in sums.items() if k > f and s == f + 1), np.zeros((2 * p + 2, 2 * p + 2)))
        if train[2 * p, 2 * p] > 0 and test[2 * p, 2 * p] > 0:
            fits.append(fit_sums(train, test, p, f, shift))
    if fits:
        place = F.element_at(F.create_map(*[x for i, f in enumerate(fits) for x in (F.lit(f.fold), F.lit(i))]), F.col("segment") - 1)
        tested = rows.withColumn("__fold", place).filter(F.col("__fold").isNotNull())
        mae = tested.groupBy("__fold").agg(F.avg(F.abs(F.col(target) - predicted(fits, features, F.col("__fold")))).alias("mae"))
        for r in mae.collect():  # a row per fold
            fits[r["__fold"]].mae = r["mae"]
    return fits
