"""Least squares on expanding folds from running sums against a fit per fold."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from windlass.operators.fold_regression import fold_least_squares, fold_segments
from windlass.operators.temporal import time_folds

FEATURES = ["a", "b", "flat", "pres"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(9)
    parts = []
    for station, n in ((1, 2600), (2, 1100), (3, 40), (4, 2)):
        x = rng.normal(size=(n, 2))
        pres = 1013 + rng.normal(0, 3, n)
        y = 2 * x[:, 0] - x[:, 1] + 0.1 * pres + rng.normal(0, 0.5, n)
        part = pd.DataFrame({"station": station, "rid": np.arange(n) + 10_000 * station, "a": x[:, 0], "b": x[:, 1], "flat": 1.0, "pres": pres, "y": y})
        part["time"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n) // 2, unit="h")  # tied times
        parts.append(part)
    pdf = pd.concat(parts)
    for c in ("a", "pres"):
        pdf.loc[rng.random(len(pdf)) < 0.1, c] = np.nan
    df = spark.createDataFrame(pdf).withColumns({c: F.nanvl(c, F.lit(None)) for c in ("a", "pres")})
    return df.withColumn("time", F.col("time").cast("timestamp_ntz")).repartition(6).cache()


def test_segments_are_the_folds(rows):
    seg = fold_segments(rows, tie="rid").select("rid", "folds", "segment").toPandas()
    folds = time_folds(rows.select("station", "time", "rid"), "station", ["time", "rid"]).toPandas()
    got = {(r.rid, f, "test" if r.segment == f + 1 else "train") for r in seg.itertuples() for f in range(r.folds) if r.segment <= f + 1}
    assert got == set(zip(folds.rid, folds.fold, folds.role))


def test_fits_are_those_of_each_fold(rows):
    fits = fold_least_squares(fold_segments(rows, tie="rid"), FEATURES, "y")
    pdf = rows.toPandas().set_index("rid")
    folds = time_folds(rows.select("station", "time", "rid"), "station", ["time", "rid"]).toPandas()
    assert [f.fold for f in fits] == sorted(folds.fold.unique())
    for fit in fits:
        own = folds[folds.fold == fit.fold]
        train, test = (pdf.loc[own[own.role == role].rid] for role in ("train", "test"))
        means = train[FEATURES].mean()
        x, xt = train[FEATURES].fillna(means).to_numpy(), test[FEATURES].fillna(means).to_numpy()
        centre = x.mean(0)
        w = np.linalg.lstsq(np.c_[x - centre, np.ones(len(x))], train.y.to_numpy(), rcond=None)[0]
        pred = (xt - centre) @ w[:-1] + w[-1]
        error = test.y.to_numpy() - pred
        assert (fit.train_rows, fit.test_rows) == (len(train), len(test))
        np.testing.assert_allclose(fit.weights[[0, 1, 3]], w[[0, 1, 3]], rtol=1e-9)
        assert fit.weights[2] == 0
        np.testing.assert_allclose(fit.means, means, rtol=1e-12)
        np.testing.assert_allclose([fit.rmse, fit.mae], [np.sqrt((error ** 2).mean()), np.abs(error).mean()], rtol=1e-9)
        np.testing.assert_allclose(fit.r2, 1 - (error ** 2).sum() / ((test.y - test.y.mean()) ** 2).sum(), rtol=1e-9)


def test_little(rows):
    assert fold_least_squares(fold_segments(rows.limit(0)), FEATURES, "y") == []
    assert fold_least_squares(fold_segments(rows.filter("station = 4"), tie="rid"), FEATURES, "y") == []
