"""What is built on the pool and its resamples carries no plans of the tables behind them, and the
work per customer of the policy bootstrap and the permutation values stays in few steps."""

import math

from pyspark.sql import functions as F

from retensa.operators import explain, policy
from retensa.plans import policy_queries as Q

from .conftest import SF_SMALL


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pool_and_resamples_are_leaves(spark):
    for df in (Q.ev2_pool(spark, SF_SMALL), Q.boot(spark, SF_SMALL)):
        assert "InMemoryRelation" not in plan_of(df) and len(plan_of(df)) < 2_000
    for query in (Q.q_policy_pairwise, Q.q_policy_arms, Q.q_policy_bootstrap):
        assert len(plan_of(query(spark, SF_SMALL))) < 100_000


def test_pool_is_made_once(spark):
    assert Q.ev2_pool(spark, SF_SMALL) is Q.ev2_pool(spark, SF_SMALL)
    assert Q.boot(spark, SF_SMALL) is Q.boot(spark, SF_SMALL)


def test_permutation_values_evaluate_no_lambda_per_row(spark):
    names = [f"f{i}" for i in range(4)]
    rows = [(1, 0.5, None, -1.0, 2.0), (2, 0.5, 0.0, -1.0, 900.0), (None, -900.0, 0.1, 0.2, 0.3)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} double" for n in names))
    got = explain.permutation_attribution(df, "id", {n: F.col(n) for n in names}, 0.25, 1)
    assert "lambdafunction" not in plan_of(got)
    value = {(r["id"], r["feature"]): r["attribution"] for r in got.collect()}

    def p(logit):
        return 1 / (1 + math.exp(-logit)) if logit > -700 else 0.0

    order = explain.permutation_table(4, 1)[0]
    for key, *deltas in rows:
        logit = 0.25
        for f in order:
            expected = None
            if logit is not None and deltas[f] is not None:
                expected = p(logit + deltas[f]) - p(logit)
            logit = None if expected is None else logit + deltas[f]
            found = value[key, names[f]]
            assert (found is None) == (expected is None)
            assert expected is None or abs(found - expected) < 1e-9


def test_bootstrap_adds_up_inside_the_tasks(spark):
    def mixed(x):
        for _ in range(2):
            x = ((x ^ (x >> 16)) * policy.MIX) & policy.MASK32
        return x ^ (x >> 16)

    rows = [(i * 2654435761 % (1 << 32) if i % 5 else i, 10.0 + i % 7, 14.25 + i % 5) for i in range(300)]
    rows += [((1 << 32) - 1, 1.0, 500.5), (None, 1.0, 3.0), (4, None, 3.0), (4, 7.5, 1.0), (4, 7.5, 1.0)]
    df = spark.createDataFrame(rows, "id long, net_a double, net_b double").repartition(3)
    got = policy.ab_bootstrap(df, "id", 40)
    assert "Generate" not in plan_of(got)
    gains = []
    for seed in range(40):
        gains.append(sum(sum(mixed(seed * 1000003 + key) / (1 << 32) >= s for s in policy.POISSON_STEPS)
                         * round((b - a) * 100) for key, a, b in rows if key is not None and a is not None) / 100)
    r = got.first()
    assert r["resamples"] == 40 and abs(r["mean_gain"] - sum(gains) / 40) < 0.006
    assert min(gains) <= r["ci_low_gain"] < r["ci_high_gain"] <= max(gains)
    none = policy.ab_bootstrap(df.where("net_a is null"), "id", 40).first()
    assert none["resamples"] == 40 and none["mean_gain"] is None
    assert policy.ab_bootstrap(df.limit(0), "id", 40).first()["resamples"] == 0
