"""A replaced file changes all that was made from its table, and nothing else."""

import shutil
import time

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from retensa.plans import model_queries, scored
from retensa.plans.mart import build_event_mart, build_mart
from retensa.sources.derived import DERIVED, files_fingerprint

from .conftest import SF_SMALL


@pytest.fixture
def folder(tmp_path):
    for name in ("customer", "orders", "lineitem", "nation", "events"):
        shutil.copy(f"{SF_SMALL}/{name}.parquet", tmp_path)
    yield str(tmp_path)
    DERIVED.clear()


def replace(spark, folder, name, change):
    """Put a changed table in the place of the old one, as another job would."""
    changed = change(spark.read.parquet(f"{SF_SMALL}/{name}.parquet"))
    changed.coalesce(1).write.mode("overwrite").parquet(f"{folder}/new")
    time.sleep(0.01)
    import glob
    shutil.copy(glob.glob(f"{folder}/new/part-*.parquet")[0], f"{folder}/{name}.parquet")


def small_training(spark, folder):
    """In place of all learners and folds, which take a minute."""
    train = VectorAssembler(inputCols=["account_balance", "tenure_days"], outputCol="features").transform(
        build_mart(spark, folder).withColumn("churn", F.col("churn").cast("double"))).cache()
    model = LogisticRegression(labelCol="churn", maxIter=3).fit(train)
    return {"train": train, "board": [("model", *model.coefficients.toArray())]}


def state(spark, folder):
    mart = build_mart(spark, folder)
    return {"mart": mart.agg(F.sum("account_balance"), F.count("*")).first(),
            "score": scored.build_scored(spark, folder).agg(F.sum("score")).first()[0],
            "card": scored.scorecard(spark, folder).mean["account_balance"],
            "board": [r[1:] for r in model_queries.training(spark, folder)["board"]],
            "events": build_event_mart(spark, folder)}


def test_replaced_file_is_noticed(spark, folder, monkeypatch):
    monkeypatch.setattr(model_queries, "_train", small_training)
    before = state(spark, folder)
    again = state(spark, folder)
    assert before["events"] is again["events"]
    assert model_queries.training(spark, folder) is model_queries.training(spark, folder)
    replace(spark, folder, "customer", lambda df: df.withColumn(
        "c_acctbal", F.lit(1000.0) - F.col("c_acctbal") * (F.col("c_custkey") % 5)))
    after = state(spark, folder)
    for part in ("mart", "score", "card", "board"):
        assert before[part] != after[part], part
    assert after["events"] is before["events"]            # its table did not change
    replace(spark, folder, "events", lambda df: df.where("user_id % 2 = 0"))
    assert build_event_mart(spark, folder).count() < before["events"].count() * 2
    assert build_event_mart(spark, folder) is not before["events"]
    assert build_mart(spark, folder).agg(F.sum("account_balance"), F.count("*")).first() == after["mart"]


def test_files_fingerprint(spark, tmp_path):
    path = str(tmp_path / "t")
    assert files_fingerprint(spark, path) == ""
    df = spark.range(10).withColumn("part", F.col("id") % 2)
    df.write.partitionBy("part").parquet(path)
    one = files_fingerprint(spark, path)
    spark.read.parquet(path).count()
    assert files_fingerprint(spark, path) == one and len(one) == 12
    spark.range(3).withColumn("part", F.lit(1)).write.mode("append").partitionBy("part").parquet(path)
    assert files_fingerprint(spark, path) != one
