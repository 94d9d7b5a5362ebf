"""Isotonic calibration on a grid, permutation attribution inside the row, text keys in the forest."""

import math
import random

import pytest
from pyspark.sql import functions as F

from retensa.operators import explain, labels, models


@pytest.mark.parametrize("seed", range(8))
def test_pooling_is_the_isotonic_fit(seed):
    rng = random.Random(seed)
    rows = [(c, n, rng.randint(0, n)) for c in sorted(rng.sample(range(60), rng.randint(1, 30)))
            for n in [rng.randint(1, 9)]]
    fit = models.IsotonicGrid(rows, 60)
    assert fit.rates == sorted(fit.rates)
    for i, (cell, _, _) in enumerate(rows):          # greatest over starts of the least over ends
        best = max(min(sum(r[2] for r in rows[a:b + 1]) / sum(r[1] for r in rows[a:b + 1])
                       for b in range(i, len(rows))) for a in range(i + 1))
        assert math.isclose(fit.rates[cell], best)
    for first, last, n, pos in fit.blocks:           # a block's value is its observed rate
        own = [r for r in rows if first <= r[0] <= last]
        assert (n, pos) == (sum(r[1] for r in own), sum(r[2] for r in own))
        assert math.isclose(fit.rates[first], pos / n)


def test_calibrated_column(spark):
    rows = [(0.0, 0), (0.05, 1), (0.14, 0), (0.5, 0), (0.55, 1), (1.0, 1), (None, 1), (0.9999, 1)]
    df = spark.createDataFrame(rows, "score double, y int")
    fit = models.isotonic(df, "y", cells=10)
    assert fit.blocks == [(0, 1, 3, 1), (5, 5, 2, 1), (9, 9, 2, 2)]
    new = spark.createDataFrame([(x,) for x in (-0.2, 0.3, 0.51, 0.7, 0.95, 1.0, 7.0, None)], "score double")
    got = [r[0] for r in new.select(fit.calibrate(F.col("score"))).collect()]
    assert got == [1 / 3, 1 / 3, 0.5, 0.5, 1.0, 1.0, 1.0, None]
    with pytest.raises(ValueError):
        models.isotonic(df.limit(0), "y")


def test_class_weights_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(models, "MAX_CLASSES", 3)
    df = spark.createDataFrame([(i % 4,) for i in range(8)], "y int")
    with pytest.raises(ValueError):
        models.class_weights(df, "y")
    assert {r["weight"] for r in models.class_weights(df.where("y < 2"), "y").collect()} == {1.0}


def test_permutation_values(spark):
    rng = random.Random(1)
    names = [f"f{i}" for i in range(7)]
    rows = [(f"C{i}", *[rng.gauss(0, 2) if j else 0.0 for j in range(7)]) for i in range(20)]
    df = spark.createDataFrame(rows, "id string, " + ", ".join(f"{n} double" for n in names))
    got = explain.permutation_attribution(df, "id", {n: F.col(n) for n in names}, -0.5, 6)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Sort" not in plan
    value = {(r["id"], r["feature"]): r["attribution"] for r in got.collect()}

    def p(logit):
        return 1 / (1 + math.exp(-logit))

    table = explain.permutation_table(7, 6)
    assert table[1] == table[0][::-1] and all(sorted(o) == list(range(7)) for o in table)
    for key, *deltas in rows:
        mean = [0.0] * 7
        for order in table:
            logit = -0.5
            for f in order:
                mean[f] += (p(logit + deltas[f]) - p(logit)) / 6
                logit += deltas[f]
        for f, name in enumerate(names):
            assert abs(value[key, name] - mean[f]) < 1e-9
        assert value[key, "f0"] == 0.0
        assert abs(sum(value[key, n] for n in names) - (p(-0.5 + sum(deltas)) - p(-0.5))) < 1e-8
    assert len(explain.permutation_table(4, 5)) == 5


def test_forest_labels_text_keys(spark):
    rng = random.Random(2)
    rows = [(f"C{i:03d}", rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(90)] + [("odd", 30.0, -30.0)]
    df = spark.createDataFrame(rows, "id string, a double, b double")
    got = {r["id"]: r for r in labels.isolation_forest_labels(df, "id", ["a", "b"], n_trees=20).collect()}
    assert len(got) == 91 and got["odd"]["label"] == 1
    assert max(got.values(), key=lambda r: r["anomaly_score"])["id"] == "odd"
