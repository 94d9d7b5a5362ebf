"""One path at every size: hot values, text keys, many levels and awkward columns."""

import datetime

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from retensa.functions.numeric import pearson
from retensa.functions.ordering import ordered_cumsum, range_bounds, range_id
from retensa.functions.quantiles import quantiles_many
from retensa.operators import actions, features, models, quality, target


@pytest.fixture(scope="module")
def hot(spark):
    """One value holds 90 % of the rows."""
    return spark.range(4000).select("id", F.when(F.col("id") % 10 > 0, 5.0).otherwise(
        F.col("id") % 97).alias("v"), F.when(F.col("id") % 13 > 0, F.col("id") % 3).alias("n"))


@pytest.mark.parametrize("desc", [False, True, [True, False, True]])
def test_running_sums_with_a_hot_value(hot, desc):
    order = ["v", "n", "id"]
    got = ordered_cumsum(hot, order, {"c": "id"}, desc, ranges=16).select("id", "c")
    flags = [desc] * 3 if isinstance(desc, bool) else desc
    w = Window.orderBy(*[F.col(c).desc_nulls_last() if f else F.col(c).asc_nulls_first()
                         for c, f in zip(order, flags)]).rowsBetween(Window.unboundedPreceding, 0)
    assert sorted(got.collect()) == sorted(hot.select("id", F.sum("id").over(w)).collect())


def test_a_hot_value_spreads_over_ranges(hot):
    order = ["v", "id"]
    bounds = range_bounds(hot, order, ranges=16)
    sizes = [r["count"] for r in hot.groupBy(range_id(hot, bounds, order)).count().collect()]
    assert len(sizes) > 10 and max(sizes) < 4000 / 16 * 3


def test_quantiles_of_many_columns(hot):
    rows = hot.toPandas()
    probs = [0.0, 0.3, 0.5, 0.91, 1.0]
    got = quantiles_many(hot, {"v": F.col("v"), "none": F.lit(None).cast("double"),
                               "n": F.col("n").cast("double")}, probs)
    assert got["none"] == [None] * 5
    assert got["v"] == pytest.approx(np.quantile(rows["v"], probs))
    assert got["n"] == pytest.approx(np.quantile(rows["n"].dropna(), probs))
    assert quantiles_many(hot.limit(0), {"v": F.col("v")}, [0.5]) == {"v": [None]}


def test_correlation_of_large_values_with_a_small_spread(spark):
    df = spark.range(20000).select((F.lit(1.7e9) + F.col("id") % 10).alias("x"),
                                   (F.col("id") % 10 + F.col("id") % 7).cast("double").alias("y"))
    rows = df.toPandas()
    expected = np.corrcoef(rows["x"] - 1.7e9, rows["y"])[0, 1]
    assert df.agg(pearson(F.col("x"), F.col("y"))).first()[0] == pytest.approx(expected, rel=1e-6)


def test_text_keys_split_and_fold(spark):
    df = spark.range(400).select(F.concat(F.lit("C"), F.lpad(F.col("id").cast("string"), 4, "0"))
                                 .alias("key"), (F.col("id") % 4 == 0).cast("int").alias("y"))
    split = features.stratified_split(df, "key", "y")
    counts = {(r["y"], r["split"]): r["count"] for r in split.groupBy("y", "split").count().collect()}
    assert counts == {(0, "train"): 225, (0, "test"): 75, (1, "train"): 75, (1, "test"): 25}
    folds = [r["count"] for r in models.add_folds(df, "key", 5).groupBy("fold").count().collect()]
    assert len(folds) == 5 and min(folds) > 40


def test_levels_have_no_limit(spark):
    df = spark.range(50_000).select("id", F.concat(F.lit("v"), F.col("id")).alias("city"))
    levels = features.level_table(df, ["city"])
    coded = features.ordinal_encode(df.where("id < 100"), levels, ["city"], keep=["id"])
    order = {v: i for i, v in enumerate(sorted(f"v{i}" for i in range(50_000)))}
    assert all(r["city_code"] == order[f"v{r['id']}"] for r in coded.collect())
    scored = df.select(F.col("id").alias("k"), (F.col("id") / 50_000).alias("score"), "city",
                       F.lit(None).cast("double").alias("empty"), F.col("id").cast("double").alias("x"))
    profile = actions.fit_low_risk_profile(scored, "k", ["x", "empty"], ["city"])
    assert "empty" not in profile.numeric and profile.categorical["city"]["low_mode"] == "v0"
    drv = actions.drivers(scored.limit(5), "k", {"x": F.lit(1.0), "empty": F.lit(1.0)}, profile,
                          ["x", "empty"])
    assert drv.where("base_feature = 'empty'").count() == 0


STRATEGY_CASES = [
    ({"yes": 3, "no": 5}, None, {"yes": 1, "no": 0}, "semantic_token_mapping"),
    ({"yes": 3, "other": 5}, None, {"yes": 1, "other": 0}, "paired_with_known_label"),
    ({"has left us": 3, "here": 5}, None, {"has left us": 1, "here": 0}, "keyword_inference"),
    ({"group a": 3, "group b": 5}, None, {"group a": 1, "group b": 0}, "minority_class_as_churn"),
    ({"group b": 4, "group a": 4}, None, {"group a": 0, "group b": 1}, "lexicographic_fallback"),
    ({"yes": 3, "no": 5, "maybe": 2}, None, {"yes": 1, "no": 0}, "partial_semantic_mapping"),
    ({"yes": 3, "no": 5}, 900, {"yes": 1, "no": 0}, "partial_semantic_mapping"),
]


@pytest.mark.parametrize("counts, n, mapping, name", STRATEGY_CASES)
def test_target_strategies(counts, n, mapping, name):
    assert target.infer_mapping(counts, n) == (mapping, name)


def test_ambiguous_and_dated_targets(spark):
    for counts in ({"a": 1, "b": 2, "c": 3}, {"a": 9}, {}):
        with pytest.raises(target.AmbiguousTarget):
            target.infer_mapping(counts)
    day = datetime.date(2020, 1, 1)
    df = spark.createDataFrame([(day,), (day,), (datetime.date(2021, 1, 1),)], "d date")
    encoded, name = target.encode_target(df, "d")
    assert name == "minority_class_as_churn"
    assert sorted(r["target"] for r in encoded.collect()) == [0, 0, 1]


def test_rfm_features_never_train(spark):
    with pytest.raises(ValueError):
        features.check_no_rfm(["a", "RFM_score"])
    assert features.drop_rfm(spark.createDataFrame([(1, 2)], "a int, rfm_x int")).columns == ["a"]


def test_many_columns_screen(spark):
    df = spark.range(200).select(*[(F.col("id") * (i + 1) % 17).cast("double").alias(f"c{i}")
                                   for i in range(5)], (F.col("id") % 17).cast("double").alias("copy"))
    report = {r["column_name"]: r["dropped"] for r in
              quality.multicollinear_report(df, df.columns).collect()}
    assert report["copy"] and not report["c0"]
