"""Unit tests of the shared expressions and the semantics traps (T1-T7, T21)."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from retensa.functions.numeric import (pearson, kurt_bias_corrected, skew_bias_corrected,
                                       to_double)
from retensa.functions.ordering import global_row_number, ordered_cumsum
from retensa.functions.quantiles import exact_quantiles
from retensa.operators import rfm, target


def test_numeric_text_coercion_matches_pandas(spark):
    vals = ["12", " 12 ", "1e3", "12d", "nan", "abc", "-3.5", ".5", None, "inf"]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r[0] for r in df.select(to_double(F.col("s"), True)).collect()]
    exp = pd.to_numeric(pd.Series(vals, dtype=object), errors="coerce").tolist()
    for g, e in zip(got, exp):
        if e is None or (isinstance(e, float) and math.isnan(e)):
            assert g is None
        else:
            assert g == pytest.approx(e)


def test_corr_constant_column_is_null_not_error(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 1.0), (1.0, 1.0)], "x double, y double")
    r = df.agg(pearson(F.col("x"), F.col("y"))).first()[0]
    assert r is None


def test_bias_corrected_moments_match_pandas(spark):
    x = [1.0, 2.0, 2.0, 3.0, 10.0, 11.0, 4.0]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    n = F.count("x").cast("double")
    r = df.agg(skew_bias_corrected(n, F.skewness("x")).alias("s"),
               kurt_bias_corrected(n, F.kurtosis("x")).alias("k")).first()
    s = pd.Series(x)
    assert r["s"] == pytest.approx(s.skew())
    assert r["k"] == pytest.approx(s.kurt())


def test_ordered_cumsum_distributed_equals_window(spark):
    df = spark.range(0, 5000).select((F.col("id") % 97).alias("g"), F.col("id").alias("k"),
                                     (F.col("id") % 7).alias("v"))
    got = ordered_cumsum(df, ["g", "k"], {"c": "v"}, ranges=6).select("k", "c")
    w = Window.orderBy("g", "k").rowsBetween(Window.unboundedPreceding, 0)
    exp = df.select("k", F.sum("v").over(w).alias("c"))
    assert sorted(got.collect()) == sorted(exp.collect())


def test_global_row_number_descending(spark):
    df = spark.createDataFrame([(i, float(i % 3)) for i in range(50)], "k long, s double")
    got = {r["k"]: r["rn"] for r in
           global_row_number(df, ["s", "k"], "rn", descending=[True, False]).collect()}
    exp = sorted(range(50), key=lambda i: (-(i % 3), i))
    assert [got[k] for k in exp] == list(range(1, 51))


def test_exact_quantiles_sorted_path_equals_numpy(spark):
    vals = [float((i * 37) % 101) / 3.0 for i in range(777)]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    probs = [0.0, 0.2, 0.25, 0.5, 0.8, 1.0]
    assert exact_quantiles(df, "v", probs) == pytest.approx(list(np.quantile(vals, probs)))


def test_quintile_duplicate_edges_fall_back_to_equal_width(spark):
    # T1: many ties -> duplicate quantile edges -> pandas.cut(bins=5)
    vals = [1.0] * 60 + [2.0, 3.0, 4.0, 5.0, 10.0] * 8
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    fit = rfm.fit_quintiles(df, F.col("v"))
    assert fit.equal_width
    got = [r[0] for r in df.select(fit.score(F.col("v"))).collect()]
    exp = pd.cut(pd.Series(vals), bins=5, labels=[1, 2, 3, 4, 5]).astype(int).tolist()
    assert got == exp


def test_quintile_scores_match_qcut(spark):
    vals = [float(x) for x in np.random.RandomState(1).gamma(2.0, 10.0, 400).round(1)]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    fit = rfm.fit_quintiles(df, F.col("v"), reverse=True)
    got = [r[0] for r in df.select(fit.score(F.col("v"))).collect()]
    exp = pd.qcut(pd.Series(vals), q=5, labels=[5, 4, 3, 2, 1]).astype(int).tolist()
    assert got == exp


@pytest.mark.parametrize("n", [2, 3, 5, 7, 10, 33, 100, 101])
def test_quartile_of_first_rank_matches_qcut(spark, n):
    # T2: qcut of rank(method='first') is not ntile(4)
    df = spark.createDataFrame([(i,) for i in range(1, n + 1)], "r long")
    got = [x[0] for x in df.select(rfm.quartile_bucket(F.col("r"), F.lit(n))).collect()]
    exp = pd.qcut(pd.Series(range(1, n + 1), dtype=float), q=4, labels=[1, 2, 3, 4]).astype(int).tolist()
    assert got == exp


@pytest.mark.parametrize("labels,strategy,positive", [
    (["Yes", "No", "no", "YES"], "semantic_token_mapping", "yes"),
    (["Churned", "Loyal", "Loyal"], "paired_with_known_label", "churned"),
    (["exited_customer", "regular"], "keyword_inference", "exited_customer"),
    (["group b", "group a", "group a"], "minority_class_as_churn", "group b"),
    (["x", "z"], "lexicographic_fallback", "z"),
])
def test_target_mapping_strategies(labels, strategy, positive):
    counts = {}
    for v in labels:
        k = v.strip().lower()
        counts[k] = counts.get(k, 0) + 1
    mapping, used = target.infer_mapping(counts)
    assert used == strategy
    assert mapping[positive] == 1


def test_target_numeric_labels_canonicalised(spark):
    df = spark.createDataFrame([(1.0,), (0.0,), (1.0,), (None,)], "y double")
    enc, strategy = target.encode_target(df, "y")
    assert strategy == "semantic_token_mapping"
    assert [r["target"] for r in enc.collect()] == [1, 0, 1, None]


def test_split_metrics_equal_those_of_each_split(spark):
    import random
    from retensa.operators import metrics
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", "b"]), rng.randint(0, 1), rng.choice([0.1, 0.35, 0.5, rng.random()]))
            for _ in range(600)] + [("one class", 1, 0.4), ("one class", 1, 0.2)]
    df = spark.createDataFrame(rows, "part string, y int, p double")
    got = {r["part"]: r for r in metrics.split_metrics(df, "part", "y", "p", 0.35).collect()}
    assert set(got) == {"a", "b", "one class"} and got["one class"]["auc"] is None
    for part in ("a", "b"):
        own = df.where(F.col("part") == part)
        plain = metrics.confusion(own, "y", "p", 0.35).first()
        for c in ("tp", "fp", "tn", "fn", "accuracy", "precision", "recall", "f1", "specificity"):
            assert got[part][c] == plain[c]
        assert abs(got[part]["auc"] - metrics.auc(own, "y", "p")) < 1e-12
        assert got[part]["n"] == own.count()
