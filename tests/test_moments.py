"""Pairwise moments in one scan against pandas, on every awkward kind of column."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from retensa.functions.moments import pair_correlations, pair_moments
from retensa.operators.quality import multicollinear_report


def frame(spark, pdf, parts=4):
    rows = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r)
            for r in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in pdf.columns)).repartition(parts)


def correlations(df):
    cols = df.columns
    return {(cols[r["a"]], cols[r["b"]]): (r["n"], r["r"])
            for r in pair_correlations(df, [F.col(c) for c in cols]).collect()}


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(1)
    n = 3000
    x = rng.normal(size=(n, 6))
    pdf = pd.DataFrame(x, columns=list("pqrstu"))
    pdf["q"] = pdf["p"] * 2 + 0.1 * pdf["q"]
    pdf["r"] = 1e9 + 1e-3 * pdf["p"]             # large with a small spread
    pdf.loc[rng.random(n) < 0.4, "s"] = np.nan
    pdf.loc[rng.random(n) < 0.97, "t"] = np.nan
    pdf["constant"] = 0.1
    pdf["nothing"] = np.nan
    pdf["step"] = np.where(np.arange(n) < n // 2, 5e8, -5e8) + pdf["u"]
    return pdf


def test_pairs_match_pandas(spark, table):
    got = correlations(frame(spark, table))
    expected = (table - table.bfill().iloc[0]).corr()      # pandas alone loses digits on "r"
    for (a, b), (n, r) in got.items():
        assert n == (table[a].notna() & table[b].notna()).sum()
        if {a, b} & {"constant"}:
            assert r is None
        else:
            assert r == pytest.approx(expected.loc[a, b], abs=1e-9)
    assert not any("nothing" in pair for pair in got)
    assert len(got) == 8 * 7 // 2


def test_partitioning_changes_nothing(spark, table):
    one, many = correlations(frame(spark, table, 1)), correlations(frame(spark, table, 13))
    for pair in one:
        assert one[pair][0] == many[pair][0]
        assert one[pair][1] == pytest.approx(many[pair][1], abs=1e-9) if one[pair][1] is not None \
            else many[pair][1] is None


def test_awkward_tables(spark):
    nan = float("nan")
    assert correlations(frame(spark, pd.DataFrame({"a": [], "b": []}))) == {}
    assert correlations(frame(spark, pd.DataFrame({"a": [1.0], "b": [2.0]}))) == {("a", "b"): (1, None)}
    assert correlations(frame(spark, pd.DataFrame({"a": [1.0, nan], "b": [nan, 2.0]}))) == {}
    two = correlations(frame(spark, pd.DataFrame({"a": [1.0, 2.0, nan], "b": [4.0, 2.0, 9.0]})))
    assert two["a", "b"] == (2, pytest.approx(-1.0))
    inf = spark.createDataFrame([(float("inf"), 1.0), (2.0, 2.0), (3.0, 5.0)], "a double, b double")
    assert correlations(inf) == {("a", "b"): (3, None)}
    moments = pair_moments(inf.where("a < 9"), [F.col("a"), F.col("b")]).first()
    assert (moments["n"], moments["mean_a"], moments["ss_a"], moments["ss_b"], moments["products"]) == (
        2, 2.5, 0.5, 4.5, 1.5)


def test_one_scan_of_200_columns(spark, tmp_path):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(400, 200))
    base[:, 150] = base[:, 3] + 0.01 * base[:, 150]
    spark.createDataFrame(pd.DataFrame(base, columns=[f"c{i}" for i in range(200)])) \
        .write.parquet(str(tmp_path / "wide"))
    wide = spark.read.parquet(str(tmp_path / "wide"))
    report = multicollinear_report(wide, wide.columns)
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert len(set(re.findall(r"FileScan parquet \[", plan))) == 1 == plan.count("FileScan parquet")
    assert [r["column_name"] for r in report.where("dropped").collect()] == ["c150"]
    assert report.count() == 200
