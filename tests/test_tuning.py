"""Tuning fits nothing twice: forests are cut from deeper ones, the winner's own point is known."""

import pytest
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from retensa.operators import models

FOLDS = 3


@pytest.fixture(scope="module")
def vec(spark):
    """Rows with repeated values, keys that come twice and a label that follows two columns loosely."""
    n = F.col("id")
    rows = spark.range(0, 900, 1, 3).unionByName(spark.range(0, 60)).select(
        "id", *[(n * p % m / 7.0).alias(f"x{i}") for i, (p, m) in enumerate([(37, 101), (53, 89), (11, 64), (29, 7)])],
        ((n * 37 % 101 + n * 11 % 64 + n * 7919 % 97) > 130).cast("double").alias("y"))
    df = models.add_folds(rows.withColumn("weight", F.when(F.col("y") == 1, 1.4).otherwise(0.8)), "id", FOLDS)
    out = VectorAssembler(inputCols=["x0", "x1", "x2", "x3"], outputCol="features").transform(
        df.coalesce(2)).cache()
    yield out
    out.unpersist()


def forest(**other):
    return RandomForestClassifier(labelCol="y", weightCol="weight", numTrees=6, seed=7, **other)


def plain(est, params, vec):
    """The mean AUC of one candidate, each fold fit on its own."""
    ev = BinaryClassificationEvaluator(labelCol="y")
    return sum(ev.evaluate(est.fit(vec.where(F.col("fold") != k), params).transform(vec.where(F.col("fold") == k)))
               for k in range(FOLDS)) / FOLDS


@pytest.fixture
def fits(monkeypatch):
    """The depths of all forests that are fit."""
    seen, fit = [], RandomForestClassifier._fit

    def counted(self, df):
        seen.append(self.getMaxDepth())
        return fit(self, df)

    monkeypatch.setattr(RandomForestClassifier, "_fit", counted)
    return seen


@pytest.mark.parametrize("depth", [0, 4, 9])
def test_cut_forest_equals_the_shallower_fit(vec, depth):
    est = forest()
    deep = est.fit(vec, {est.maxDepth: 8})
    own, want = models.cut_forest(deep, depth), est.fit(vec, {est.maxDepth: min(depth, 8)})
    assert own.totalNumNodes == want.totalNumNodes
    assert [t.depth for t in own.trees] == [t.depth for t in want.trees]
    score = lambda m: {r["id"]: r["p"] for r in m.transform(vec).select(
        "id", vector_to_array("probability")[1].alias("p")).collect()}
    assert score(own) == pytest.approx(score(want), rel=1e-12)


def test_cut_forest_keeps_the_column_names(vec):
    est = forest(probabilityCol="chance", rawPredictionCol="raw")
    cut = models.cut_forest(est.fit(vec, {est.maxDepth: 5}), 2)
    assert {"chance", "raw"} <= set(cut.transform(vec).columns)


def test_forests_of_one_grid_are_fit_once(vec, fits):
    est = forest()
    grid = [{est.maxDepth: d} for d in (3, 6, 5)] + [{est.maxDepth: 6, est.maxBins: 16}]
    own = models.cross_validate([(est, p) for p in grid], vec, "y", FOLDS)
    assert sorted(fits) == [6] * 2 * FOLDS
    assert own == pytest.approx([plain(est, p, vec) for p in grid], rel=1e-9)


def test_forests_grown_in_groups_are_fit_each(vec, fits):
    """With little memory MLlib grows a level in several groups, and its draws depend on the depth."""
    est = forest(maxMemoryInMB=0)
    grid = [{est.maxDepth: d} for d in (2, 4)]
    own = models.cross_validate([(est, p) for p in grid], vec, "y", FOLDS)
    assert sorted(fits) == [2] * FOLDS + [4] * FOLDS
    assert own == pytest.approx([plain(est, p, vec) for p in grid], rel=1e-9)


@pytest.mark.parametrize("make, param, values", [
    (lambda: LogisticRegression(labelCol="y", weightCol="weight", maxIter=5, regParam=0.1), "regParam",
     [0.0, 0.01, 0.1]),
    (lambda: forest(maxDepth=6), "maxDepth", [4, 6, 8]),
    (lambda: GBTClassifier(labelCol="y", weightCol="weight", maxIter=2, maxDepth=4, seed=7), "maxDepth", [3, 4, 5])])
def test_tuned_as_by_the_whole_grid(vec, monkeypatch, fits, make, param, values):
    est = make()
    param = getattr(est, param)
    each = {v: plain(est, {param: v}, vec) for v in values}
    own = est.getOrDefault(param)
    asked, cross_validate = [], models.cross_validate

    def counted(candidates, *rest):
        asked.extend(p[param] for _, p in candidates)
        return cross_validate(candidates, *rest)

    monkeypatch.setattr(models, "cross_validate", counted)
    fits.clear()
    best = {"estimator": est, "model": est.fit(vec), "cv_auc": each[own]}
    fits.clear()
    model, auc, tuned = models.tune(best, vec, "y", FOLDS)
    assert asked == [v for v in values if v != own]
    assert fits == [] or fits[:FOLDS] == [max(values)] * FOLDS and len(fits) == FOLDS + tuned
    assert auc == pytest.approx(max(each.values()), rel=1e-9)
    assert tuned == (max(each.values()) > each[own])
    if tuned:
        assert model.getOrDefault(param.name) == max(values, key=each.get)
    assert models.tune(best | {"cv_auc": 1.0}, vec, "y", FOLDS) == (best["model"], 1.0, False)


def test_fewer_fits_at_a_time_on_many_tasks():
    assert [models.fits_at_a_time(tasks, 8) for tasks in (1, 4, 8, 14, 90, 10_000)] == [8, 8, 4, 3, 2, 2]
    assert models.fits_at_a_time(0, 1) == 4


def test_prepared_table_drops_what_its_vectors_were_made_from(vec):
    df = vec.drop("features").withColumn("c", F.when(F.col("id") % 3 > 0, F.col("id") % 3).cast("string"))
    _, out, (other,) = models.prepare(df, [df], ["x0", "x1"], ["c"], "id")
    assert set(out.columns) == {"id", "x2", "x3", "y", "weight", "fold", "features"}
    assert {"x0", "c", "features"} <= set(other.columns)
    attrs = out.schema["features"].metadata["ml_attr"]["attrs"]
    assert {a["name"] for g in attrs.values() for a in g} >= {"x0__imp", "x1__imp"}
    assert out.count() == df.count()
    out.unpersist()
