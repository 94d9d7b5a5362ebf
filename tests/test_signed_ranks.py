"""Signed ranks per group against plain ranking, and the bootstrap with text keys."""

import random

from pyspark.sql import functions as F

from retensa.operators import policy, stats


def plain(diffs):
    """(n, W+, W-, z) by sorting."""
    d = sorted((x for x in diffs if x), key=abs)
    ranks, i, ties = [], 0, 0
    while i < len(d):
        j = i
        while j < len(d) and abs(d[j]) == abs(d[i]):
            j += 1
        ranks += [(i + 1 + j) / 2] * (j - i)
        ties += (j - i) ** 3 - (j - i)
        i = j
    plus = sum(r for r, x in zip(ranks, d) if x > 0)
    minus = sum(r for r, x in zip(ranks, d) if x < 0)
    n = len(d)
    var = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return n, plus, minus, (min(plus, minus) - n * (n + 1) / 4) / var ** 0.5 if var > 0 else None


def close(a, b):
    return (a is None and b is None) or abs(a - b) < 1e-9


def test_groups_are_ranked_apart(spark):
    rng = random.Random(6)
    rows = [(g, float(rng.randint(-spread, spread + shift)) / 2)
            for g, n, spread, shift in [("a", 400, 6, 2), ("b", 7, 40, 0), (None, 60, 3, 1), ("zero", 5, 0, 0),
                                        ("one", 1, 9, 9), ("wide", 300, 10 ** 6, 10 ** 5)]
            for _ in range(n)]
    rows += [("a", None), ("b", 0.0)]
    df = spark.createDataFrame(rows, "g string, d double").repartition(7)
    got = {r["g"]: r for r in stats.signed_ranks(df, "d", ("g",)).collect()}
    for g in {r[0] for r in rows}:
        n, plus, minus, z = plain([d for h, d in rows if h == g and d is not None])
        if not n:
            assert g not in got
            continue
        r = got[g]
        assert (r["n"], r["w_plus"], r["w_minus"], r["statistic"]) == (n, plus, minus, min(plus, minus))
        assert close(r["z"], z)
    whole = stats.wilcoxon(df, "d").first()
    assert (whole["n"], whole["w_plus"]) == plain([d for _, d in rows if d is not None])[:2]
    ranks = {(r["g"], r["v"]): r["_rank"] for r in stats.value_ranks(
        df.groupBy("g", F.col("d").alias("v")).agg(F.count("*").alias("n")), "v", "n", True, ("g",)).collect()}
    assert ranks["a", max(d for g, d in rows if g == "a" and d is not None)] < 40
    assert min(r for (g, _), r in ranks.items() if g == "wide") == 1.0


def test_no_rows(spark):
    none = spark.createDataFrame([], "g string, d double")
    assert stats.signed_ranks(none, "d", ("g",)).count() == 0
    r = stats.wilcoxon(none, "d").first()
    assert r["n"] == 0 and not r["tested"] and not r["significant"] and r["p_value"] is None


def test_pairwise_needs_pairs_and_a_difference(spark):
    arms = policy.ARMS
    rows = []
    for seed in range(12):
        own = 100.0 + 7 * (seed % 5)
        rows += [(seed, arms[3], own), (seed, arms[0], own - 1 - seed), (seed, arms[1], own)]
        if seed < 9:
            rows.append((seed, arms[2], own + (1 if seed % 2 else -3)))
    boot = spark.createDataFrame(rows, "seed long, arm string, total_net_benefit double")
    got = {r["baseline"]: r for r in policy.pairwise(boot).collect()}
    first = got[arms[0]]
    assert (first["n_pairs"], first["n_nonzero"], first["wilcoxon_statistic"]) == (12, 12, 0.0)
    assert first["significant_at_005"] and first["wilcoxon_p_value"] < 0.01
    for base, n, nonzero in ((arms[1], 12, 0), (arms[2], 9, 9)):
        r = got[base]
        assert (r["n_pairs"], r["n_nonzero"]) == (n, nonzero)
        assert r["wilcoxon_statistic"] is None and r["wilcoxon_p_value"] is None and r["significant_at_005"] is None


def test_bootstrap_interval_of_text_keys(spark):
    rows = [(f"C{i:03d}", 10.0 + i % 7, 14.0 + i % 5) for i in range(200)]
    df = spark.createDataFrame(rows, "id string, net_a double, net_b double")
    r = policy.ab_bootstrap(df, "id", 50).first()
    total = sum(b - a for _, a, b in rows)
    assert r["resamples"] == 50 and r["ci_low_gain"] < total < r["ci_high_gain"] and r["share_positive"] == 1.0
