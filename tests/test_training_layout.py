"""Training tables are laid out by their rows; folds are validated as MLlib's cross validator does."""

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from retensa.operators import models


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(0, 600, 1, 40).select(
        "id", (F.col("id") * 37 % 101 / 10.0).alias("a"), (F.col("id") * 53 % 89 / 9.0).alias("b"),
        ((F.col("id") * 37 % 101 + F.col("id") * 11 % 60) > 80).cast("double").alias("y"))


def test_layout_follows_rows(table, monkeypatch):
    assert models.laid_out(table, "id").rdd.getNumPartitions() == 1
    monkeypatch.setattr(models, "TASK_ROWS", 100)
    parts = models.laid_out(table, "id")
    assert parts.rdd.getNumPartitions() == 6
    assert sorted(r["id"] for r in parts.collect()) == list(range(600))
    assert models.laid_out(table.limit(0), "id").count() == 0


def test_prepared_table_has_few_tasks(table):
    _, vec, _ = models.prepare(table.withColumn("weight", F.lit(1.0)), [], ["a", "b"], [], "id")
    assert vec.rdd.getNumPartitions() == 1 and vec.count() == 600
    vec.unpersist()


def test_cross_validation_equals_the_cross_validator(table):
    vec = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(
        models.add_folds(table, "id", 3)).cache()
    est = LogisticRegression(labelCol="y", maxIter=5)
    grid = ParamGridBuilder().addGrid(est.regParam, [0.0, 0.5]).build()
    own = models.cross_validate([(est, p) for p in grid], vec, "y", 3)
    want = CrossValidator(estimator=est, estimatorParamMaps=grid, foldCol="fold", numFolds=3,
                          evaluator=BinaryClassificationEvaluator(labelCol="y")).fit(vec).avgMetrics
    assert own == pytest.approx(list(want), rel=1e-9)
    with pytest.raises(ValueError):
        models.cross_validate([(est, grid[0])], vec.where("fold < 2"), "y", 3)
    vec.unpersist()
