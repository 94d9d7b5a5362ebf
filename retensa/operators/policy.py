"""Spending-policy evaluation (EV1-EV4, AG3, AG6, AG7, AG12, AG16, AG17, JN4,
JN7, TK2, TK3, TK7).

EV1 compares a generic campaign (A) with each customer's best priced action
(B) over every at-risk customer.  EV2 compares four selection arms under a
fixed budget inside a candidate pool, then re-runs the selection on bootstrap
resamples.  Resampling is integer arithmetic on (seed, draw), so it is
repeatable, partition-independent, and reproducible in SQL; resample rows are
generated with ``range`` and joined to the pool by position.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import round_half_up
from ..functions.ordering import global_row_number, key_number
from ..functions.quantiles import quantiles_many
from .explain import is_immutable
from .stats import SIGNIFICANT, WILCOXON_MIN_PAIRS, signed_ranks, two_sided_p

# ---- fixed values (must equal the reference's) -------------------------------
GENERIC_EFFECTIVENESS = 0.30
GENERIC_MARGIN = 0.35
GENERIC_EXECUTION_EV1 = 0.65
GENERIC_EXECUTION_EV2 = 0.65
DEFAULT_MARGIN = 0.35
DEFAULT_EXECUTION = 0.70
TIER_COSTS = (30.0, 50.0, 75.0)
TIER_QUANTILES = (0.33, 0.66)
CLV_CLAMP = (100.0, 100000.0)
DEFAULT_CLV = 1680.0
POOL_SIZE = 100
BUDGET = 30
MIN_BOOTSTRAP = 20
BOOTSTRAP = 100
TOP_SHARE = 0.20
ARMS = ["Prediction Only", "Prediction x CLV", "Prediction + SHAP", "Integrated AI + SHAP"]
# ------------------------------------------------------------------------------

MASK32 = 4294967295
MIX = 73244475


def mix32(x: Column) -> Column:
    """32-bit integer mixer (xor-shift-multiply), the same in Spark and SQL."""
    for _ in range(2):
        x = ((x.bitwiseXOR(F.shiftright(x, 16))) * F.lit(MIX)).bitwiseAND(F.lit(MASK32))
    return x.bitwiseXOR(F.shiftright(x, 16))


def mix32_array(x: np.ndarray) -> np.ndarray:
    """``mix32`` of whole numbers below 2**48: 32 bits are left of each round's product."""
    for _ in range(2):
        x = (x ^ (x >> 16)).astype(np.uint32) * np.uint32(MIX)
    return x ^ (x >> 16)


def sql_mix32(x: str) -> str:
    for _ in range(2):
        x = f"((xor({x}, ({x} >> 16)) * {MIX}) & {MASK32})"
    return f"xor({x}, ({x} >> 16))"


def tier_cost(clv: Column, p33: float, p66: float) -> Column:
    return (F.when(clv <= F.lit(p33), TIER_COSTS[0]).when(clv <= F.lit(p66), TIER_COSTS[1])
            .otherwise(TIER_COSTS[2]))


def ev1_table(at_risk: DataFrame, best: DataFrame, segments: DataFrame, key: str,
              clv_global: float, features: list[str]) -> DataFrame:
    """One row per at-risk customer: policy A (generic) and B (best action)."""
    b = best.select(key, F.col("base_feature").alias("top_feature"),
                    F.col("predicted_churn_prob").alias("pred_after"),
                    F.col("implementation_cost").alias("cost_b_raw"),
                    F.col("customer_clv").alias("clv_b"), F.col("value_saved").alias("saved_b_raw"))
    x = (at_risk.select(key, "score").join(b, key, "left")
         .join(segments, key, "left"))
    immutable_feats = [f for f in features if is_immutable(f)]
    pr_raw = F.col("score") - F.col("pred_after")
    pr = F.greatest(F.lit(0.0), F.coalesce(round_half_up(pr_raw, 4), F.lit(0.0)))
    cost = F.coalesce(F.col("cost_b_raw"), F.lit(0.0))
    clv0 = F.coalesce(F.col("clv_b"), F.lit(0.0))
    fallback = pr * clv0 * F.lit(DEFAULT_MARGIN) * F.lit(DEFAULT_EXECUTION)
    saved = F.coalesce(F.col("saved_b_raw"), fallback)
    x = x.select(
        key, round_half_up(F.col("score"), 4).alias("churn_prob"),
        F.when(F.col("top_feature").isNull() | F.col("top_feature").isin(immutable_feats), 0)
        .otherwise(1).alias("b_actionable"),
        "top_feature", round_half_up(pr_raw, 4).alias("prob_reduction"),
        F.col("clv_b").alias("customer_clv"), F.col("cost_b_raw").alias("cost_b"),
        round_half_up(saved, 2).alias("saved_b"), round_half_up(saved - cost, 2).alias("net_b"),
        F.when(cost > 0, round_half_up(saved / cost, 2)).otherwise(0.0).alias("roi_b"),
        F.coalesce(F.col("rfm_segment"), F.lit("Unknown")).alias("rfm_segment"),
        F.coalesce(F.col("clv_b"), F.lit(clv_global)).alias("clv_a"))
    qs = quantiles_many(x, {"c": F.col("clv_a")}, list(TIER_QUANTILES))["c"]
    cost_a = tier_cost(F.col("clv_a"), qs[0], qs[1])
    saved_a = round_half_up(F.least(F.greatest(F.col("churn_prob"), F.lit(0.0)), F.lit(1.0))
                            * F.col("clv_a") * F.lit(GENERIC_EFFECTIVENESS)
                            * F.lit(GENERIC_MARGIN) * F.lit(GENERIC_EXECUTION_EV1), 2)
    return x.withColumn("cost_a", cost_a).withColumn("saved_a", saved_a) \
        .withColumn("net_a", round_half_up(F.col("saved_a") - F.col("cost_a"), 2))


def ev1_segments(t: DataFrame) -> DataFrame:
    """Segment summary rounded to 3 places (AG3)."""
    return t.groupBy("rfm_segment").agg(
        F.count(F.lit(1)).alias("count"),
        round_half_up(F.avg("churn_prob"), 3).alias("avg_churn_prob"),
        round_half_up(F.avg("roi_b"), 3).alias("avg_roi"),
        round_half_up(F.avg(F.coalesce("cost_b", F.lit(0.0))), 3).alias("avg_cost"),
        round_half_up(F.avg(F.coalesce("prob_reduction", F.lit(0.0))), 3)
        .alias("avg_prob_reduction"))


def top_share_ids(t: DataFrame, key: str, col: str, k: int) -> DataFrame:
    ranked = global_row_number(t.select(key, col), [col, key], "_r", descending=[True, False])
    return ranked.where(F.col("_r") <= k).select(key)


def ev1_headline(t: DataFrame, key: str) -> DataFrame:
    """Totals per policy, improvement %, top-20 % overlap, ROI > 1 count (AG17, AG16, TK7)."""
    n = t.count()
    k = max(1, int(n * TOP_SHARE))
    a_ids = top_share_ids(t, key, "churn_prob", k)
    b_ids = top_share_ids(t, key, "roi_b", k)
    overlap = a_ids.join(b_ids, key, "left_semi").count() / k
    s = t.agg(F.count(F.lit(1)).alias("total_high_risk_customers"),
              F.avg("b_actionable").alias("actionability_rate_b"),
              F.sum("net_a").alias("total_value_a"), F.sum("net_b").alias("total_value_b"),
              F.count_if(F.col("roi_b") > 1).alias("customers_with_positive_roi"),
              F.avg(F.coalesce("prob_reduction", F.lit(0.0))).alias("avg_prob_reduction"))
    gain = (F.col("total_value_b") - F.col("total_value_a")) / \
        F.greatest(F.abs(F.col("total_value_a")), F.lit(1.0)) * 100.0
    return s.select("total_high_risk_customers",
                    round_half_up(F.col("actionability_rate_b"), 4).alias("actionability_rate_b"),
                    round_half_up(F.lit(overlap), 4).alias("top20_priority_overlap"),
                    round_half_up(F.col("total_value_a"), 2).alias("total_retention_value_a"),
                    round_half_up(F.col("total_value_b"), 2).alias("total_retention_value_b"),
                    round_half_up(gain, 2).alias("value_improvement_pct"),
                    "customers_with_positive_roi",
                    round_half_up(F.col("avg_prob_reduction"), 4).alias("avg_prob_reduction"))


def pool_members(scored: DataFrame, key: str, pool_size: int = POOL_SIZE) -> DataFrame:
    """The rows of the candidate pool: the ``pool_size`` highest scores (TK2).  As their
    number is a parameter, they are broadcast."""
    keys = scored.select(key, "score").orderBy(F.col("score").desc(), F.col(key)).limit(
        int(max(1, pool_size))).select(key)
    return scored.join(F.broadcast(keys), key, "left_semi")


def ev2_pool(scored: DataFrame, best: DataFrame, signal: DataFrame, key: str,
             clv: Column, features: list[str], pool_size: int = POOL_SIZE) -> DataFrame:
    """Candidate pool: top-N by score (TK2), with every arm's columns."""
    n = scored.count()
    pool_size = int(max(1, min(pool_size, n)))
    full = scored.select(key, "score", clv.alias("clv"))
    qs = quantiles_many(full, {"c": F.col("clv")}, list(TIER_QUANTILES))["c"]
    pool = (full.orderBy(F.col("score").desc(), F.col(key)).limit(pool_size)
            .withColumn("pool_pos", F.row_number().over(
                Window.orderBy(F.col("score").desc(), F.col(key)))))   # <= pool_size rows
    immut = [f for f in features if is_immutable(f)]
    b = best.select(key, F.col("base_feature").alias("int_feature"),
                    F.col("implementation_cost").alias("int_cost"),
                    F.col("prob_reduction").alias("int_pr"),
                    F.col("value_saved").alias("int_saved0"))
    s = signal.select(key, "top_feature", "signal_sum", "top_value")
    x = pool.join(b, key, "left").join(s, key, "left")
    gcost = tier_cost(F.col("clv"), qs[0], qs[1])
    gpr = F.least(F.greatest(F.col("score") * GENERIC_EFFECTIVENESS, F.lit(0.0)), F.lit(1.0))
    gsaved = gpr * F.col("clv") * F.lit(GENERIC_MARGIN) * F.lit(GENERIC_EXECUTION_EV2)
    int_act = F.col("int_feature").isNotNull() & ~F.col("int_feature").isin(immut)
    isaved = F.when(F.col("int_saved0") > 0, F.col("int_saved0")).otherwise(
        F.coalesce(F.col("int_pr"), F.lit(0.0)) * F.col("clv"))
    icost = F.coalesce(F.col("int_cost"), F.lit(0.0))
    shap_act = F.col("top_feature").isNotNull() & ~F.col("top_feature").isin(immut)
    sig = F.col("score") * F.greatest(F.coalesce("signal_sum", F.lit(0.0)),
                                      F.coalesce("top_value", F.lit(0.0)))
    return x.select(
        key, "pool_pos", round_half_up(F.col("score"), 6).alias("pred_only_score"),
        round_half_up(F.col("score") * F.col("clv"), 6).alias("pred_clv_score"),
        round_half_up(gpr, 6).alias("generic_prob_reduction"),
        round_half_up(gsaved, 2).alias("generic_value_saved"),
        round_half_up(gsaved - gcost, 2).alias("generic_net_benefit"),
        round_half_up(F.when(gcost > 0, gsaved / gcost).otherwise(0.0), 4).alias("generic_roi"),
        F.when(shap_act, 1).otherwise(0).alias("shap_actionable"),
        round_half_up(F.when(shap_act, sig).otherwise(0.0), 6).alias("shap_signal_score"),
        F.when(int_act, 1).otherwise(0).alias("integrated_actionable"),
        round_half_up(F.coalesce(F.col("int_pr"), F.lit(0.0)), 6).alias("integrated_prob_reduction"),
        round_half_up(F.when(int_act, isaved).otherwise(0.0), 2).alias("integrated_value_saved"),
        F.when(int_act, round_half_up(isaved - icost, 2)).alias("integrated_net_benefit"),
        round_half_up(F.when(int_act & (icost > 0), isaved / icost).otherwise(0.0), 4)
        .alias("integrated_roi"))


ARM_COLS = {
    "Prediction Only": ("pred_only_score", "generic_net_benefit", "generic_value_saved",
                        "generic_roi", "generic_prob_reduction", None),
    "Prediction x CLV": ("pred_clv_score", "generic_net_benefit", "generic_value_saved",
                         "generic_roi", "generic_prob_reduction", None),
    "Prediction + SHAP": ("shap_signal_score", "generic_net_benefit", "generic_value_saved",
                          "generic_roi", "generic_prob_reduction", "shap_actionable"),
    "Integrated AI + SHAP": ("integrated_net_benefit", "integrated_net_benefit",
                             "integrated_value_saved", "integrated_roi",
                             "integrated_prob_reduction", "integrated_actionable"),
}


def arm_rows(pool: DataFrame, extra: list[str] = ()) -> DataFrame:
    """Stack the pool into one row per (candidate, arm) with uniform columns."""
    parts = []
    for arm, (score, net, val, roi, pr, act) in ARM_COLS.items():
        ok = F.col(score).isNotNull() & (F.col(act) == 1 if act else F.lit(True))
        parts.append(pool.where(ok).select(
            *extra, "customer_id", F.lit(arm).alias("arm"), F.col(score).alias("arm_score"),
            F.col(net).alias("net"), F.col(val).alias("value"), F.col(roi).alias("roi"),
            F.col(pr).alias("pr")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def select_budget(rows: DataFrame, budget: int, by: list[str], order_extra: list[str]) -> DataFrame:
    """Top ``budget`` per group by arm score (TK3)."""
    w = Window.partitionBy(*by).orderBy(F.col("arm_score").desc(), *order_extra)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= budget).drop("_r")


def arm_summary(selected: DataFrame) -> DataFrame:
    integ = selected.where(F.col("arm") == "Integrated AI + SHAP").select("customer_id") \
        .withColumn("_int", F.lit(1))
    n_int = integ.count()
    x = selected.join(integ, "customer_id", "left")
    return x.groupBy("arm").agg(
        F.count(F.lit(1)).alias("selected_customers"),
        round_half_up(F.sum("value"), 2).alias("total_value_saved"),
        round_half_up(F.sum("net"), 2).alias("total_net_benefit"),
        round_half_up(F.avg("roi"), 4).alias("avg_roi"),
        round_half_up(F.avg("pr"), 4).alias("avg_prob_reduction"),
        round_half_up(F.avg((F.col("roi") > 1).cast("double")), 4).alias("positive_roi_rate"),
        round_half_up(F.count("_int") / F.lit(float(max(n_int, 1))), 4)
        .alias("selection_overlap_vs_integrated"))


# cumulative Poisson(1) probabilities: how often a row stands in one resample (fixed values)
POISSON_STEPS = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676)
AB_BOOTSTRAP = 1000


def ab_bootstrap(t: DataFrame, key: str, n_boot: int = AB_BOOTSTRAP) -> DataFrame:
    """Interval of the total gain of policy B over A (EV3).

    No rows are drawn: in each of ``n_boot`` resamples a row's weight is a Poisson(1) count
    from the hash of (seed, key).  Every task adds up its rows per seed, an Arrow batch at a time, so
    only ``n_boot`` sums a task are shuffled.  Sums are whole cents, exact in any order.
    """
    number = key_number(t, key)                # below 2**32 the key itself; the mixer needs as much
    folded = number.bitwiseXOR(F.shiftrightunsigned(number, 32)).bitwiseAND(F.lit(MASK32))
    cents = t.select(folded.alias("_key"), F.round((F.col("net_b") - F.col("net_a")) * 100).cast("long")
                     .alias("cents"))
    # draw >= step for the draw bits / 2**32
    steps = [np.uint32(math.ceil(step * (1 << 32))) for step in POISSON_STEPS]

    def add_up(batches):
        sums, rows, known = np.zeros(n_boot, dtype=np.int64), 0, 0
        for batch in batches:
            rows += batch.num_rows
            both = pc.and_(batch.column(0).is_valid(), batch.column(1).is_valid())
            keys, gains = (batch.column(i).filter(both).to_numpy(zero_copy_only=False).astype(np.int64)
                           for i in (0, 1))
            known += len(keys)
            for seed in range(n_boot):
                bits = mix32_array(keys + seed * 1000003)
                weight = np.zeros(len(keys), dtype=np.int8)
                for step in steps:
                    weight += bits >= step
                sums[seed] += np.dot(weight.astype(np.int64), gains)
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(n_boot), pa.int32()), pa.array(sums, mask=np.full(n_boot, not known))],
                names=["seed", "cents"])

    each = cents.mapInArrow(add_up, "seed int, cents long")
    gains = each.groupBy("seed").agg(F.sum("cents").alias("cents"))
    gain = F.col("cents") / 100.0
    return gains.agg(
        F.count(F.lit(1)).alias("resamples"), round_half_up(F.avg(gain), 2).alias("mean_gain"),
        round_half_up(F.percentile(gain, 0.025), 2).alias("ci_low_gain"),
        round_half_up(F.percentile(gain, 0.975), 2).alias("ci_high_gain"),
        round_half_up(F.avg((gain > 0).cast("double")), 4).alias("share_positive"))


def bootstrap_draws(spark, pool_n: int, n_boot: int) -> DataFrame:
    """(seed, draw, pool_pos): pool_n draws with replacement per seed."""
    r = spark.range(0, n_boot * pool_n)
    seed = F.floor(F.col("id") / F.lit(pool_n)).cast("long")
    draw = F.col("id") % pool_n
    pos = mix32(seed * F.lit(1000003) + draw) % F.lit(pool_n) + 1
    return r.select(seed.alias("seed"), draw.alias("draw"), pos.alias("pool_pos"))


def bootstrap_arms(spark, pool: DataFrame, n_boot: int = BOOTSTRAP, budget: int = BUDGET) -> DataFrame:
    pool_n = pool.count()
    n_boot = int(max(MIN_BOOTSTRAP, n_boot))
    draws = bootstrap_draws(spark, pool_n, n_boot)
    rows = arm_rows(pool, extra=["pool_pos"])
    res = draws.join(rows, "pool_pos")       # pool side is bounded by pool size x 4 arms
    sel = select_budget(res, budget, ["seed", "arm"], ["draw"])
    agg = sel.groupBy("seed", "arm").agg(
        F.count(F.lit(1)).alias("selected_customers"), F.sum("net").alias("total_net_benefit"),
        F.sum("value").alias("total_value_saved"), F.avg("roi").alias("avg_roi"),
        F.avg("pr").alias("avg_prob_reduction"))
    # every (seed, arm) exists; an arm that selects nobody totals 0
    grid = spark.range(0, n_boot).select(F.col("id").alias("seed"),
                                         F.explode(F.array(*[F.lit(a) for a in ARMS])).alias("arm"))
    out = grid.join(agg, ["seed", "arm"], "left")
    return out.select("seed", "arm", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in
                                      ("selected_customers", "total_net_benefit",
                                       "total_value_saved", "avg_roi", "avg_prob_reduction")])


def bootstrap_summary(boot: DataFrame) -> DataFrame:
    return boot.groupBy("arm").agg(
        round_half_up(F.avg("total_net_benefit"), 4).alias("mean_total_net_benefit"),
        round_half_up(F.stddev_samp("total_net_benefit"), 4).alias("std_total_net_benefit"),
        round_half_up(F.percentile("total_net_benefit", 0.025), 4).alias("ci_low_total_net_benefit"),
        round_half_up(F.percentile("total_net_benefit", 0.975), 4).alias("ci_high_total_net_benefit"),
        round_half_up(F.avg("avg_roi"), 4).alias("mean_avg_roi"),
        round_half_up(F.avg("avg_prob_reduction"), 4).alias("mean_avg_prob_reduction"))


def run_parameters(pool: DataFrame, boot: DataFrame) -> DataFrame:
    """One row: what a policy run was made with, counted where the data decide."""
    counted = pool.agg(F.count(F.lit(1)).alias("candidate_pool_size")).crossJoin(
        boot.agg(F.count_distinct("seed").alias("bootstrap_repetitions")))      # one row each
    return counted.select(
        "candidate_pool_size", F.lit(BUDGET).alias("decision_budget"), "bootstrap_repetitions",
        F.lit(GENERIC_EFFECTIVENESS).alias("generic_effectiveness"),
        F.lit(GENERIC_MARGIN).alias("generic_margin_rate"),
        F.lit(GENERIC_EXECUTION_EV2).alias("generic_execution_prob"),
        F.lit(POOL_SIZE).alias("pool_limit"), F.lit(MIN_BOOTSTRAP).alias("least_repetitions"))


#: differences are ranked to this many places, so that ties don't hang on the order of sums
RANKED_PLACES = 6


def pairwise(boot: DataFrame) -> DataFrame:
    """Integrated arm against each baseline per seed, with the signed-rank test of the
    differences (JN7, EV4).  The test needs ``WILCOXON_MIN_PAIRS`` pairs and a difference."""
    mine = boot.where(F.col("arm") == ARMS[-1]).select("seed", F.col("total_net_benefit").alias("own"))
    theirs = boot.where(F.col("arm").isin(ARMS[:-1])).select(
        "seed", F.col("arm").alias("baseline"), F.col("total_net_benefit").alias("base"))
    diff = F.col("own") - F.col("base")
    x = theirs.join(mine, "seed").where(diff.isNotNull()).select(
        "baseline", diff.alias("diff"), F.when(F.col("base") != 0, diff / F.col("base") * 100.0).alias("imp"),
        round_half_up(diff, RANKED_PLACES).alias("ranked"))
    sd = F.stddev_samp("diff")

    def share(p: float) -> Column:
        return round_half_up(F.coalesce(F.percentile("imp", p), F.lit(0.0)), 4)

    summary = x.groupBy("baseline").agg(
        F.count(F.lit(1)).alias("n_pairs"), round_half_up(F.avg("diff"), 4).alias("mean_net_benefit_diff"),
        share(0.5).alias("median_value_improvement_pct"), share(0.025).alias("ci_low_value_improvement_pct"),
        share(0.975).alias("ci_high_value_improvement_pct"),
        round_half_up(F.when(sd > 1e-9, F.avg("diff") / sd).otherwise(0.0), 4).alias("cohens_d"))
    ranks = signed_ranks(x, "ranked", ("baseline",)).select(
        "baseline", F.col("n").alias("n_nonzero"), "w_plus", "w_minus", "statistic", "z")
    tested = (F.col("n_pairs") >= WILCOXON_MIN_PAIRS) & (F.coalesce("n_nonzero", F.lit(0)) > 0)
    p = round_half_up(two_sided_p(F.col("z")), 6)
    return summary.join(ranks, "baseline", "left").select(
        "baseline", "n_pairs", "mean_net_benefit_diff", "median_value_improvement_pct",
        "ci_low_value_improvement_pct", "ci_high_value_improvement_pct", "cohens_d",
        F.coalesce("n_nonzero", F.lit(0)).alias("n_nonzero"),
        F.when(tested, round_half_up(F.col("statistic"), 4)).alias("wilcoxon_statistic"),
        F.when(tested, p).alias("wilcoxon_p_value"),
        F.when(tested, F.coalesce(p < SIGNIFICANT, F.lit(False))).alias("significant_at_005"))
