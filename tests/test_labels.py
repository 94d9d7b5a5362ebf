"""Labelling end to end on planted truth, and the forest's draw at any size."""

import pytest
from pyspark.sql import functions as F

from retensa.operators import labels as L


@pytest.fixture(scope="module")
def planted(spark):
    """A tenth of the rows differ in every column."""
    odd = F.col("id") % 10 == 0
    noise = F.pmod(F.xxhash64("id"), F.lit(100)) / 100.0
    return spark.range(600).select("id", odd.cast("int").alias("truth"), *[
        (F.when(odd, F.lit(-9.0 - i)).otherwise(5.0) + noise * (i + 1)).alias(f"c{i}") for i in range(5)])


def test_methods_find_the_planted_rows(planted):
    cols = [f"c{i}" for i in range(5)]
    table = planted.drop("truth")
    made, method, trust = L.auto_labels(table, "id", cols)
    assert method == "clustering" and 0 < trust <= 1
    assert made.join(planted, "id").where("label <> truth").count() == 0
    made, method, _ = L.auto_labels(table.select("id", "c0", "c1"), "id", cols[:2])
    assert method == "anomaly"
    found = made.join(planted, "id").where("truth = 1")
    assert found.where("label = 1").count() >= 0.9 * found.count()


def test_degenerate_labels_fall_back(spark):
    table = spark.range(300).select("id", F.lit(3.0).alias("tenure"), F.lit(2.0).alias("charge"),
                                    F.lit(1.0).alias("usage"), (F.col("id") % 7).cast("double").alias("z"))
    _, method, trust = L.auto_labels(table, "id", ["z"], "heuristic")
    assert method == "anomaly" and trust <= L.FALLBACK_RELIABILITY_CAP


def test_draw_stays_bounded():
    for n in (10, 300, 10 ** 4, 10 ** 7, 10 ** 10):
        draws, share = L.draw_plan(n, 100, 256)
        assert draws <= 100 and n * draws * share <= 2 * 256 * 100 * 1.001
    assert L.draw_plan(10 ** 10, 100, 256)[0] == 1


def test_draw_fills_every_tree(spark):
    rows = spark.range(20000).select(F.col("id").alias("k"))
    sizes = [r["count"] for r in L.tree_members(rows, 20000, 20, 64, 1).groupBy("t").count().collect()]
    assert len(sizes) == 20 and min(sizes) > 64 and max(sizes) < 4 * 64
