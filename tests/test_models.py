"""Model checks: closed forms for linear models, bounds for trees."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from windlass.plans import binned_trees, boosting
from windlass.plans import models as ml
from windlass.plans.features import feature_names, feature_table
from windlass.sources import standins as sv


def test_one_feature_ols_equals_regr_slope(spark, smoke_dir):
    o = sv.obs(spark, smoke_dir).dropna(subset=["wspd", "pres"])
    r = o.agg(F.regr_slope("wspd", "pres").alias("s"), F.regr_intercept("wspd", "pres").alias("i")).first()
    m = LinearRegression(featuresCol="f", labelCol="wspd", regParam=0.0).fit(
        VectorAssembler(inputCols=["pres"], outputCol="f").transform(o))
    assert m.coefficients[0] == pytest.approx(r["s"], rel=1e-6)
    assert m.intercept == pytest.approx(r["i"], rel=1e-6)


def test_multi_feature_ols_equals_lstsq(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    y = x @ np.array([1.5, -2.0, 0.5]) + 3 + rng.normal(scale=0.1, size=300)
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=y)
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="f").transform(spark.createDataFrame(pdf))
    m = LinearRegression(featuresCol="f", labelCol="y", regParam=0.0).fit(df)
    coef, *_ = np.linalg.lstsq(np.c_[x, np.ones(300)], y, rcond=None)
    np.testing.assert_allclose(list(m.coefficients) + [m.intercept], coef, rtol=1e-6)


def test_feature_table_has_171_features(spark, smoke_dir):
    t = feature_table(sv.obs(spark, smoke_dir), sv.stations(spark, smoke_dir))
    assert len(feature_names(t)) == 171
    assert t.filter(F.col("condition").isNull()).count() == 0


@pytest.fixture(scope="module")
def rings(spark):
    """Three classes of points whose borders are rings and a diagonal, a rare one weighted up; an empty and a constant feature."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 3))
    r = np.hypot(x[:, 0], x[:, 1])
    label = np.where(r < 0.5, "core", np.where(x[:, 2] + 0.7 * x[:, 0] > 0, "upper", "lower"))
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(flat=1.0, empty=np.nan, label=label, part=rng.random(1500))
    df = spark.createDataFrame(pdf).repartition(4).cache()
    return df.filter("part < 0.7"), df.filter("part >= 0.7")


def test_boosting_beats_the_forest(spark, rings):
    train, test = rings
    weight = F.when(F.col("label") == "core", 4.0).otherwise(1.0)
    feats = ["a", "b", "c", "flat"]
    model = boosting.boost_classes(train, feats, "label", weight, rounds=60, rate=0.3, depth=4)
    assert model.labels == ["core", "lower", "upper"]
    scored = model.transform(test).cache()
    p = np.array([r["probabilities"] for r in scored.collect()])
    assert np.allclose(p.sum(1), 1) and (p >= 0).all()
    assert {r["predicted_label"] == model.labels[int(np.argmax(r["probabilities"]))] for r in scored.collect()} == {True}
    asm = VectorAssembler(inputCols=feats, outputCol="x")
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.functions import vector_to_array
    index = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc").fit(train)
    forest = RandomForestClassifier(featuresCol="x", labelCol="y", weightCol="w", numTrees=100, maxDepth=10, seed=42).fit(
        index.transform(asm.transform(train)).withColumn("w", weight))
    old = forest.transform(asm.transform(test)).withColumn("probabilities", vector_to_array("probability"))
    loss = [boosting.weighted_log_loss(t, model.labels, "label", weight) for t in (scored, old)]
    assert loss[0] < loss[1]
    importances = dict(model.importances())
    assert sum(importances.values()) == pytest.approx(1) and importances["flat"] == 0
    assert list(importances.values()) == sorted(importances.values(), reverse=True)


def test_weighted_log_loss_is_the_formula(spark):
    rows = [("x", [0.5, 0.5], 1.0), ("y", [0.9, 0.1], 3.0), ("z", [0.2, 0.8], 1.0)]
    df = spark.createDataFrame(rows, "label string, probabilities array<double>, w double")
    want = -(np.log(0.5) + 3 * np.log(0.1) + np.log(boosting.LOG_FLOOR)) / 5
    assert boosting.weighted_log_loss(df, ["x", "y"], "label", F.col("w")) == pytest.approx(want)
    assert boosting.weighted_log_loss(df.limit(0), ["x", "y"], "label") is None


def test_boosting_of_one_class_and_null_labels(spark):
    df = spark.createDataFrame([("only", 1.0), ("only", 2.0), (None, 3.0)], "label string, a double")
    model = boosting.boost_classes(df, ["a"], "label", rounds=2)
    assert [(r["predicted_label"], r["probabilities"]) for r in model.transform(df).collect()] == [("only", [1.0])] * 3
    assert model.importances() == [("a", 0.0)]


def test_classifier_results_and_unknown_name(spark, smoke_dir):
    st = sv.stations(spark, smoke_dir)
    t = feature_table(sv.obs(spark, smoke_dir), st)
    res = ml.condition_classifier(t, st, rounds=3, max_depth=4)
    assert res["confusion_matrix"].count() == 16
    imp = res["feature_importance"].toPandas()
    assert len(imp) == 15 and (imp.importance.diff().dropna() <= 0).all()
    trained = {r["station"] for r in res["training_stations"].collect()}
    tested = {r["station"] for r in res["predictions"].select("station").distinct().collect()}
    assert trained and tested and not trained & tested
    perf = res["geographic_performance"].toPandas()
    assert {"station", "name", "latitude", "longitude", "accuracy", "samples"} <= set(perf.columns) and perf["name"].notna().all()
    with pytest.raises(ValueError):
        ml.classification_result(t, st, "pie_chart")


def test_direction_features_hold_place_and_city(spark, smoke_dir):
    f = ml.direction_features(sv.obs(spark, smoke_dir), sv.stations(spark, smoke_dir))
    assert {"latitude", "longitude", "elevation", "city", "condition_group", *ml.DIRECTION_NUMERIC, *ml.DIRECTION_CLOCK} <= set(f.columns)
    assert not [c for c in f.columns if c.startswith("doy")] and f.filter("city IS NULL").count() == 0


def test_tree_training_parts_follow_bytes_not_files(spark, monkeypatch):
    """Every part sends statistics for every tree level, so many small files must not become many parts."""
    seen = []

    class Seen:
        def __init__(self, **kw):
            pass

        def fit(self, rows):
            seen.append(rows.rdd.getNumPartitions())
            return 1.0

    monkeypatch.setattr(boosting, "GBTClassifier", Seen)
    df = spark.range(0, 4000, 1, 40).select(F.col("id").cast("double").alias("a"), F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("label"))
    boosting.boost_classes(df, ["a"], "label")
    assert seen == [1, 1]
    for n in (0, 10 ** 5, 10 ** 7, 10 ** 9):
        parts = boosting.training_parts(n, 171, 12)
        assert n * 171 * 4 / parts <= boosting.MOST_BYTES and (parts == 1 or n * 800 / parts >= boosting.LEAST_BYTES / 2)


def test_feature_rows_are_not_shuffled_when_wide(spark, smoke_dir):
    obs = spark.createDataFrame(sv.obs(spark, smoke_dir).limit(300).collect(), sv.obs(spark, smoke_dir).schema)
    st = spark.createDataFrame(sv.stations(spark, smoke_dir).collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = feature_table(obs, st)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_direction_fits_read_rows_spread_over_the_cores(spark, smoke_dir, monkeypatch):
    """The observations come in one split; the stored rows do not, and the trees get few parts of them."""
    seen, made = [], {}

    class Trees(ml.GBTRegressor):
        def fit(self, rows):
            seen.append(rows.rdd.getNumPartitions())
            return super().fit(rows)

    def kept(df, name, real=boosting.stored):
        made[name] = df.rdd.getNumPartitions()
        return real(df, name)

    monkeypatch.setattr(ml, "GBTRegressor", Trees)
    monkeypatch.setattr(ml, "stored", kept)
    monkeypatch.setattr(boosting, "LEAST_BYTES", 1000)  # many parts of few rows
    out = ml.direction_model(sv.obs(spark, smoke_dir).coalesce(1), sv.stations(spark, smoke_dir), gbt_iter=2).collect()
    assert len(out) == 2 and len({r["test_rows"] for r in out}) == 1
    cores = spark.sparkContext.defaultParallelism
    assert made["direction_rows"] == cores and all(1 < n <= cores for n in seen)


def test_many_parts_train_the_trees_of_spark_ml_over_shared_rows(spark, monkeypatch):
    """Rows of more than one part make the same ensembles as Spark ML does of one part, without an ensemble's own copy of the rows."""
    rng = np.random.default_rng(10)
    x = rng.normal(size=(3000, 5))
    x[:, 3], x[:, 4] = rng.integers(0, 2, 3000), rng.integers(0, 24, 3000)
    label = np.where(np.hypot(x[:, 0], x[:, 1]) < 0.6, "core", np.where(x[:, 2] + 0.7 * x[:, 0] + 0.5 * x[:, 3] + rng.normal(0, 0.3, 3000) > 0, "up", "low"))
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcde")).assign(flat=2.0, label=label)).repartition(3).cache()
    weight, feats = F.when(F.col("label") == "core", 4.0).otherwise(1.5), [*"abcde", "flat"]
    one = boosting.boost_classes(df, feats, "label", weight, rounds=6, depth=4)
    monkeypatch.setattr(boosting, "LEAST_BYTES", 1000)
    monkeypatch.setattr(boosting, "GBTClassifier", None)  # before, each class trained on binned rows of its own
    many = boosting.boost_classes(df, feats, "label", weight, rounds=6, depth=4)
    a, b = (m.transform(df).orderBy("a").toPandas() for m in (one, many))
    np.testing.assert_allclose(np.stack(a.probabilities), np.stack(b.probabilities), atol=1e-9)
    assert (a.predicted_label == b.predicted_label).all() and many.labels == one.labels
    np.testing.assert_allclose([v for _, v in many.importances()], [v for _, v in one.importances()], atol=1e-9)
    assert [f for f, _ in many.importances()] == [f for f, _ in one.importances()]


def test_boosted_values_of_many_parts_equal_spark_ml(spark):
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import GBTRegressor
    rng = np.random.default_rng(11)
    x = rng.normal(size=(2500, 4))
    y = np.stack([np.sin(x[:, 0] * 2) + rng.normal(0, 0.2, 2500), np.abs(x[:, 1]) * x[:, 2]], 1)
    df = spark.createDataFrame(pd.DataFrame(np.hstack([x, y]), columns=["a", "b", "c", "d", "y0", "y1"])).repartition(2)
    rows = VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features").transform(df).cache()
    binned = rows.select(vector_to_array("features").alias("__x"), "y0", "y1", F.lit(1.0).alias("__w"))
    trees, layout = binned_trees.boost(binned, ["__x"], ["y0", "y1"], 2500, 2500.0, float(np.abs(y).max()), 0, 8, 0.1, 5, 42)
    for t, target in zip(trees, ("y0", "y1")):
        new = binned_trees.spark_model(spark, t, layout, 0.1, False).setFeaturesCol("features").setPredictionCol("p")
        old = GBTRegressor(featuresCol="features", labelCol=target, maxIter=8, maxDepth=5, stepSize=0.1, seed=42, predictionCol="q").fit(rows.coalesce(1))
        r = old.transform(new.transform(rows)).select("p", "q").toPandas()
        np.testing.assert_allclose(r.p, r.q, atol=1e-9)


def test_many_parts_reject_weights_and_targets_that_spark_ml_rejects(spark, monkeypatch):
    monkeypatch.setattr(boosting, "LEAST_BYTES", 100)
    df = spark.range(0, 200).select(F.col("id").cast("double").alias("a"), F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("label"))
    for weight in (F.lit(-1.0), F.when(F.col("a") > 5, 1.0)):
        with pytest.raises(Exception, match="weights of at least 0"):
            boosting.boost_classes(df, ["a"], "label", weight, rounds=1)


class Parts(list):
    """Parts of blocks, with the calls that growing a tree makes."""

    def getNumPartitions(self):
        return len(self)

    def mapPartitions(self, f):
        return Parts(list(f(iter(p))) for p in self)

    def treeReduce(self, f, depth):
        out = None
        for p in self:
            for x in p:
                out = x if out is None else f(out, x)
        return out


def test_trees_do_not_depend_on_dealing_or_on_what_workers_remember(monkeypatch):
    rng = np.random.default_rng(12)
    x = np.hstack([rng.normal(size=(4000, 3)), rng.integers(0, 2, (4000, 8))])
    x[::9, 1], x[:, 2] = np.nan, 5.0
    y, w = (x[:, 0] > 0.3).astype(int) + (x[:, 3] * x[:, 4]).astype(int), rng.choice([0.1, 1.0, 325.0], 4000)
    layout = binned_trees.Layout([binned_trees.cuts_of(v, w) for v in x.T], binned_trees.CELLS)
    assert layout.group[2] == -1 and max(layout.sizes) <= binned_trees.CELLS and len(layout.sizes) == 2  # 32 x 32 and eight of two
    codes = layout.codes(list(x.T))

    def grown(deal, room):
        monkeypatch.setattr(binned_trees, "HELD_BYTES", room)
        job = binned_trees.Job(f"{deal}{room}", layout, True, 0.1, 4, 3, (2.0 ** 30, 2.0 ** 28), [[], [], []])
        parts = Parts([(f"{i}-{j}", len(rows), codes[:, rows].tobytes(), w[rows].tobytes(), y[rows].astype(np.int32).tobytes())
                       for j, rows in enumerate(np.array_split(part, 3))] for i, part in enumerate(np.array_split(rng.permutation(4000), deal)))
        for _ in range(4):
            binned_trees._grown(parts, job)
            for trees, tree in zip(job.done, job.growing):
                trees.append(tree)
        binned_trees._held.clear()
        return [np.concatenate([t.feature, t.cut, t.value, t.weight, t.gain]) for trees in job.done for t in trees]

    first = grown(1, 2 ** 27)
    assert all((t[:32] >= 0).sum() > 3 for t in first)
    for deal, room in ((1, 0), (5, 2 ** 27), (3, 20_000)):  # nothing, all, some blocks remembered
        for a, b in zip(first, grown(deal, room)):
            np.testing.assert_array_equal(a, b)


def test_thresholds_hold_missing_values_apart():
    assert binned_trees.cuts_of(np.array([1.0, 3.0, np.nan, 3.0]), np.ones(4)).tolist() == [2.0, 3.0]
    assert binned_trees.cuts_of(np.array([7.0, 7.0]), np.ones(2)).tolist() == [] == binned_trees.cuts_of(np.array([np.nan]), np.ones(1)).tolist()
    assert binned_trees.cuts_of(np.array([-np.inf, np.inf, 1e308, 1.7e308]), np.ones(4)).tolist() == [-np.inf, 1e308, 1.7e308]
    x = np.random.default_rng(1).normal(size=20_000)
    cuts = binned_trees.cuts_of(x, np.ones(20_000))
    assert len(cuts) == binned_trees.BINS - 1 and np.bincount(np.searchsorted(cuts, x)).max() < 700


def test_feature_rows_with_any_null_are_dropped_by_few_columns(spark, smoke_dir):
    """The filter reads a part of the 144 columns, and drops the same rows as one on all of them: nulls and divisors of 0."""
    from windlass.plans import features
    named = [c if k == 0 else f"{c}_lag{k}" for k in range(4) for c in [*features.RAW, *features.DERIVED]]
    assert len(named) == 144 and set(features.may_be_null()) < set(named) and len(features.may_be_null()) < 50
    rng = np.random.default_rng(13)
    obs = sv.obs(spark, smoke_dir).limit(600).toPandas()
    for c in features.RAW:
        obs[c] = obs[c].fillna(1.0).mask(rng.random(len(obs)) < 0.02)
    obs["station"], obs["coco"] = 1, 5
    obs.loc[40::97, "rhum"], obs.loc[50::89, "wspd"], obs.loc[60::101, "pres"] = -0.01, -0.01, -10.0
    g = {k: 1.0 for k in ("pres_mean", "temp_mean", "pres_q10", "wspd_q90", "temp_q10", "temp_q90")}
    df = spark.createDataFrame(obs.astype(object).where(obs.notna(), None), sv.obs(spark, smoke_dir).schema)
    st = sv.stations(spark, smoke_dir)
    got = feature_table(df, st, g)
    pandas = got.toPandas()
    assert 50 < len(pandas) < 500 and not pandas[named].isna().any().any()
    every, features_null = list(named), features.may_be_null
    try:
        features.may_be_null = lambda: every
        assert sorted(feature_table(df, st, g).toPandas()["time"]) == sorted(pandas["time"])
    finally:
        features.may_be_null = features_null


def test_direction_trees_of_many_parts_share_rows(spark, smoke_dir, monkeypatch):
    monkeypatch.setattr(boosting, "LEAST_BYTES", 1000)
    monkeypatch.setattr(ml, "GBTRegressor", None)  # before, each target trained on binned rows of its own
    out = {r["model"]: r for r in ml.direction_model(sv.obs(spark, smoke_dir), sv.stations(spark, smoke_dir), gbt_iter=3).collect()}
    assert set(out) == {"LinearRegression", "GradientBoostedTrees"} and sum(r["best"] for r in out.values()) == 1
    assert len({r["test_rows"] for r in out.values()}) == 1
