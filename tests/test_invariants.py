"""Invariants from the survey's test plan, on sf0.001."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from retensa.operators import metrics as M
from retensa.plans.scored import build_scored

from .conftest import SF_SMALL

Q = E.queries()


def test_segment_counts_sum_to_customers(spark):
    rows = Q["rfm_distribution"](spark, SF_SMALL).collect()
    assert sum(r["customers"] for r in rows) == 150
    assert abs(sum(r["pct"] for r in rows) - 100.0) < 0.5


def test_auc_of_inverted_score(spark):
    s = build_scored(spark, SF_SMALL)
    a = M.auc(s, "churn", "score")
    b = M.auc(s.withColumn("score", 1 - F.col("score")), "churn", "score")
    assert abs(a + b - 1.0) < 1e-9


def test_gains_end_at_one(spark):
    g = {r["pct"]: r["gain"] for r in Q["gains_curve"](spark, SF_SMALL).collect()}
    assert abs(g[100] - 1.0) < 1e-12
    assert all(g[i] <= g[i + 1] + 1e-12 for i in range(1, 100))


def test_net_benefit_is_saving_minus_cost(spark):
    for r in Q["action_values"](spark, SF_SMALL).collect():
        assert abs(r["net_benefit"] - (r["value_saved"] - r["implementation_cost"])) <= 0.0100001


def test_arms_respect_budget(spark):
    for r in Q["policy_arms"](spark, SF_SMALL).collect():
        assert r["selected_customers"] <= 30


def test_planted_leaks_found(spark):
    leaks = {r["column_name"] for r in Q["leak_numeric"](spark, SF_SMALL).collect()
             if r["is_leak"]}
    assert {"leak_copy", "leak_inverse"} <= leaks


def test_split_proportions_exact(spark):
    rows = Q["stratified_split"](spark, SF_SMALL).groupBy("churn", "split").count().collect()
    by = {(r["churn"], r["split"]): r["count"] for r in rows}
    for c in (0, 1):
        n = by.get((c, "train"), 0) + by.get((c, "test"), 0)
        assert by.get((c, "test"), 0) == (n * 25 + 99) // 100


def test_isolation_forest_flags_contamination_share(spark):
    lab = Q["label_isolation_forest"](spark, SF_SMALL)
    share = lab.agg(F.avg("label")).first()[0]
    assert 0.25 <= share <= 0.35


def test_validation_report_has_both_leak_screens(spark):
    rows = Q["validation_report"](spark, SF_SMALL).where("section like '%leakage'").collect()
    expected = {(name, r["column_name"], r["is_leak"]) for name, query in (
        ("leakage", "leak_numeric"), ("categorical leakage", "leak_categorical"))
        for r in Q[query](spark, SF_SMALL).collect()}
    assert {(r["section"], r["key"], r["severity"] == "CRITICAL") for r in rows} == expected
    assert ("categorical leakage", "leak_group", True) in expected


def test_json_summary_has_the_pairwise_tests(spark):
    import json
    doc = Q["json_summary"](spark, SF_SMALL).first()
    pairs = json.loads(doc["pairwise_tests"])
    assert [p["baseline"] for p in pairs] == [
        r["baseline"] for r in Q["policy_pairwise"](spark, SF_SMALL).collect()]
    assert doc["arm_metrics"] and doc["bootstrap_summary"]
