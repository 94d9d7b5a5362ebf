"""The fitted alignment stage on rows of every awkward kind; saved, loaded, in a stream."""

import json

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array

from retensa.operators.alignment import ColumnAligner, ColumnAlignment
from retensa.operators.features import fit_levels
from retensa.streaming.scoring import score_new_files

TRAIN = [("C1", 1.5, 3, "a b", "yes", True, 1.0), ("C2", None, 4, "  c ", "No ", False, 0.0),
         ("C3", 2.5, None, None, None, None, 1.0), ("C4", -2.0, 7, "a b", "y", True, 0.0)]
SCHEMA = "id string, amount double, visits int, town string, member string, active boolean, churn double"
INPUTS = ["amount", "visits", "town", "member", "active"]


@pytest.fixture(scope="module")
def train(spark):
    return spark.createDataFrame(TRAIN, SCHEMA)


@pytest.fixture(scope="module")
def aligner(train):
    return ColumnAlignment(inputCols=INPUTS, carried=["id"]).fit(train)


def test_fitted_columns(aligner):
    assert {c["name"]: (c["kind"], c["type"], c["levels"]) for c in aligner.fitted()} == {
        "amount": ("number", "double", None), "visits": ("number", "int", None),
        "town": ("text", "string", ["a_b", "c"]), "member": ("flag", "int", None),
        "active": ("flag", "int", None)}


def test_the_training_table_itself(train, aligner):
    got = aligner.transform(train)
    assert got.columns == ["id", *INPUTS]
    assert [tuple(r) for r in got.orderBy("id").collect()] == [
        ("C1", 1.5, 3, "a_b", 1, 1), ("C2", 0.0, 4, "c", 0, 0), ("C3", 2.5, 0, "Unknown", 0, 0),
        ("C4", -2.0, 7, "a_b", 1, 1)]


def test_another_table(spark, aligner):
    rows = [("n/a", 9.9, "x", "MAYBE", "more"), ("12", 1e300, "a  b", " YES", "more"),
            (" 7.25 ", float("nan"), None, None, "more"), ("inf", float("inf"), "A B", "0", "more"),
            ("", -3.7, "Unknown", "t", "more")]
    df = spark.createDataFrame(rows, "amount string, visits double, town string, member string, amounts string")
    got = aligner.transform(df)
    assert got.columns == ["id", *INPUTS]
    assert [tuple(r) for r in got.collect()] == [
        (None, 0.0, 9, "Unknown", 0, 0), (None, 12.0, 0, "a_b", 1, 0), (None, 7.25, 0, "Unknown", 0, 0),
        (None, 0.0, 0, "Unknown", 0, 0), (None, 0.0, -3, "Unknown", 1, 0)]
    assert aligner.transform(df.limit(0)).count() == 0
    nothing = spark.createDataFrame([("only",)], "other string")
    assert [tuple(r) for r in aligner.transform(nothing).collect()] == [(None, 0.0, 0, "Unknown", 0, 0)]


def test_many_levels_are_kept_as_text(spark):
    df = spark.createDataFrame([(f"t{i % 30}", f"u{i % 4}") for i in range(90)], "many string, few string")
    fitted = ColumnAlignment(inputCols=["many", "few"], maxLevels=29).fit(df)
    levels = {c["name"]: c["levels"] for c in fitted.fitted()}
    assert levels == {"many": None, "few": ["u0", "u1", "u2", "u3"]}
    new = spark.createDataFrame([("t99", "u9")], "many string, few string")
    assert tuple(fitted.transform(new).first()) == ("t99", "Unknown")
    assert ColumnAlignment(inputCols=["many"], maxLevels=30).fit(df).fitted()[0]["levels"] is not None
    with pytest.raises(ValueError):
        fit_levels(df, ["many"], most=29)


def test_empty_training_table(spark, train):
    fitted = ColumnAlignment(inputCols=INPUTS).fit(train.limit(0))
    assert fitted.transform(train).count() == 4


def test_saved_in_a_pipeline_and_streamed(spark, train, tmp_path):
    stages = [ColumnAlignment(inputCols=INPUTS, carried=["id", "churn"]),
              StringIndexer(inputCol="town", outputCol="town_i", handleInvalid="keep"),
              OneHotEncoder(inputCol="town_i", outputCol="town_v"),
              VectorAssembler(inputCols=["amount", "visits", "member", "active", "town_v"], outputCol="features"),
              LogisticRegression(labelCol="churn", maxIter=5)]
    model = Pipeline(stages=stages).fit(train)
    model.write().overwrite().save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model"))
    assert isinstance(again.stages[0], ColumnAligner)
    assert json.loads(again.stages[0].getOrDefault("columns")) == model.stages[0].fitted()
    new = spark.createDataFrame([("N1", "8", "zz", 1), ("N2", "bad", "a b", 2), ("N3", None, None, 3)],
                                "id string, amount string, town string, surplus int")
    expected = sorted(tuple(r) for r in model.transform(new).select(
        "id", vector_to_array("probability")[1]).collect())
    assert len(expected) == 3
    files, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    for i in range(3):                     # one file at a time, each run resumes
        new.where(f"surplus = {i + 1}").coalesce(1).write.mode("append").parquet(files)
        score_new_files(spark, again, new.schema, files, out, progress, key="id")
        assert spark.read.parquet(out).count() == i + 1
    score_new_files(spark, again, new.schema, files, out, progress, key="id")
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == expected
