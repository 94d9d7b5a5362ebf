"""Policy evaluation (EV1, EV2), bootstrap, pairwise tests and rank statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import sql_round_half_up as rhu
from ..functions.quantiles import quantiles_many
from ..operators import actions as A
from ..operators import metrics as M
from ..operators import policy as P
from ..operators import stats as S
from ..operators.explain import is_immutable
from ..session import reliable_checkpoint
from .action_queries import (ACTIONABLE, ACTIONS_SQL, ATTR_SQL, INPUTS, KEY, LINEAGE,
                             priced, signal_table, value_table)
from .registry import register
from .rfm_queries import MART_RFM_SQL, mart_rfm_segments
from .mart import cached, kept_small
from .scored import build_scored
from .sqlgen import d

IMMUTABLE = [b for b in INPUTS if is_immutable(b)]
IMM_SQL = ", ".join(f"'{b}'" for b in IMMUTABLE) or "''"
THR = M.DEFAULT_THRESHOLD


# ------------------------------------------------------------------ Spark side
def best_actions(spark, sf_dir):
    return A.top_actions(A.dedupe_actions(value_table(spark, sf_dir), KEY), KEY) \
        .where(F.col("action_rank") == 1)


def clv_global(s, revenue=("revenue", "charge", "amount"), length=("tenure", "duration")):
    """Median revenue times median length of stay, of the first columns named so."""
    names = [f.name for f in s.schema.fields if f.dataType.typeName() in (
        "double", "float", "integer", "long")]
    money, time = (next(c for c in names if any(w in c.lower() for w in words))
                   for words in (revenue, length))
    qs = quantiles_many(s, {"r": F.col(money).cast("double"), "t": F.col(time).cast("double")}, [0.5])
    return max(100.0, min(100000.0, qs["r"][0] * qs["t"][0]))


def ev1(spark, sf_dir):
    return cached(spark, ("ev1", sf_dir), lambda: _ev1(spark, sf_dir))


def _ev1(spark, sf_dir):
    s = build_scored(spark, sf_dir)
    n_risk = s.where(F.col("score") > THR).count()
    thr = THR if n_risk >= M.MIN_AT_RISK else M.FALLBACK_THRESHOLD
    at_risk = s.where(F.col("score") > thr)
    segs = mart_rfm_segments(spark, sf_dir, keep=()).select(KEY, "rfm_segment")
    return P.ev1_table(at_risk, best_actions(spark, sf_dir), segs, KEY, clv_global(s), INPUTS)


def ev2_pool(spark, sf_dir):
    return kept_small(spark, ("ev2_pool", sf_dir), lambda: _ev2_pool(spark, sf_dir))


def _ev2_pool(spark, sf_dir):
    s = build_scored(spark, sf_dir)
    med = quantiles_many(s, {"m": F.col("monthly_charges")}, [0.5])["m"][0]
    clv = F.least(F.greatest(F.coalesce(F.col("monthly_charges"), F.lit(med)) * F.lit(24.0),
                             F.lit(100.0)), F.lit(100000.0))
    # actions are built and priced for the members of the pool alone
    members = reliable_checkpoint(P.pool_members(s, KEY))
    best = A.top_actions(A.dedupe_actions(priced(spark, sf_dir, members), KEY), KEY).where(
        F.col("action_rank") == 1)
    return P.ev2_pool(s, best, signal_table(spark, sf_dir, members), KEY, clv, INPUTS)


# ------------------------------------------------------------------ SQL side
EV1_SQL = f"""{ACTIONS_SQL}, {MART_RFM_SQL},
thr AS (SELECT CASE WHEN COUNT(*) FILTER (WHERE score > {d(THR)}) < 20 THEN {d(M.FALLBACK_THRESHOLD)}
               ELSE {d(THR)} END AS t FROM scored),
ar AS (SELECT scored.{KEY}, scored.score FROM scored, thr WHERE score > t),
gclv AS (SELECT LEAST({d(100000.0)}, GREATEST({d(100.0)}, quantile_cont(total_revenue, 0.5)
               * quantile_cont(CAST(tenure_days AS DOUBLE), 0.5))) AS clv_global FROM scored),
e0 AS (SELECT ar.{KEY}, ar.score, top.base_feature AS top_feature, top.predicted_churn_prob AS pred_after,
              top.implementation_cost AS cost_b_raw, top.customer_clv AS clv_b, top.value_saved AS saved_b_raw,
              seg.rfm_segment
       FROM ar LEFT JOIN top ON top.{KEY} = ar.{KEY} AND top.action_rank = 1
       LEFT JOIN seg ON seg.{KEY} = ar.{KEY}),
e1 AS (SELECT {KEY}, {rhu('score', 4)} AS churn_prob,
         CASE WHEN top_feature IS NULL OR top_feature IN ({IMM_SQL}) THEN 0 ELSE 1 END AS b_actionable,
         top_feature, {rhu('score - pred_after', 4)} AS prob_reduction, clv_b AS customer_clv,
         cost_b_raw AS cost_b,
         COALESCE(saved_b_raw, GREATEST({d(0.0)}, COALESCE({rhu('score - pred_after', 4)}, {d(0.0)}))
                  * COALESCE(clv_b, {d(0.0)}) * {d(P.DEFAULT_MARGIN)} * {d(P.DEFAULT_EXECUTION)}) AS saved_raw,
         COALESCE(cost_b_raw, {d(0.0)}) AS cost0, COALESCE(rfm_segment, 'Unknown') AS rfm_segment,
         COALESCE(clv_b, clv_global) AS clv_a
       FROM e0, gclv),
e2 AS (SELECT *, {rhu('saved_raw', 2)} AS saved_b, {rhu('saved_raw - cost0', 2)} AS net_b,
              CASE WHEN cost0 > 0 THEN {rhu('saved_raw / cost0', 2)} ELSE {d(0.0)} END AS roi_b FROM e1),
qa AS (SELECT quantile_cont(clv_a, 0.33) AS p33, quantile_cont(clv_a, 0.66) AS p66 FROM e2),
ev1 AS (SELECT e2.*, CASE WHEN clv_a <= p33 THEN {d(30.0)} WHEN clv_a <= p66 THEN {d(50.0)} ELSE {d(75.0)} END AS cost_a,
          {rhu(f'LEAST(GREATEST(churn_prob, {d(0.0)}), {d(1.0)}) * clv_a * {d(0.30)} * {d(0.35)} * {d(0.65)}', 2)} AS saved_a
        FROM e2, qa),
ev1t AS (SELECT *, {rhu('saved_a - cost_a', 2)} AS net_a FROM ev1)"""
EV1_COLS = ("customer_id, churn_prob, b_actionable, top_feature, prob_reduction, customer_clv, cost_b, "
            "saved_b, net_b, roi_b, rfm_segment, clv_a, cost_a, saved_a, net_a")


_DRAW = P.sql_mix32(f"(seed * 1000003 + {KEY})")


@register("policy_ab_bootstrap", f"""{EV1_SQL},
g AS (SELECT seed, SUM(({' + '.join(f'CAST(u >= {d(x)} AS BIGINT)' for x in P.POISSON_STEPS)}) * cents) / {d(100.0)} AS gain
      FROM (SELECT seed, cents, {_DRAW} / {d(4294967296.0)} AS u
            FROM (SELECT {KEY}, CAST(ROUND((net_b - net_a) * 100) AS BIGINT) AS cents FROM ev1t) x,
                 (SELECT range AS seed FROM range({P.AB_BOOTSTRAP})) s) y GROUP BY seed)
SELECT COUNT(*) AS resamples, {rhu('AVG(gain)', 2)} AS mean_gain,
  {rhu('quantile_cont(gain, 0.025)', 2)} AS ci_low_gain, {rhu('quantile_cont(gain, 0.975)', 2)} AS ci_high_gain,
  {rhu(f'AVG(CASE WHEN gain > 0 THEN {d(1.0)} ELSE {d(0.0)} END)', 4)} AS share_positive FROM g""")
def q_policy_ab_bootstrap(spark, sf_dir):
    return P.ab_bootstrap(ev1(spark, sf_dir), KEY)


def _arm_sql(src, extra):
    parts = []
    for arm, (score, net, val, roi, pr, act) in P.ARM_COLS.items():
        cond = f"{score} IS NOT NULL" + (f" AND {act} = 1" if act else "")
        parts.append(f"SELECT {extra}{KEY}, '{arm}' AS arm, {score} AS arm_score, {net} AS net, "
                     f"{val} AS value, {roi} AS roi, {pr} AS pr FROM {src} WHERE {cond}")
    return " UNION ALL ".join(parts)


ARMS_LIST_SQL = ", ".join(f"('{a}')" for a in P.ARMS)
EV2_SQL = f"""{ACTIONS_SQL}, {ATTR_SQL},
ab AS (SELECT {KEY}, CASE feature {' '.join(f"WHEN '{f}' THEN '{b}'" for f, b in LINEAGE.items())} END AS base_feature,
              contribution FROM attr),
rb AS (SELECT {KEY}, base_feature, SUM(contribution) AS contribution FROM ab GROUP BY 1, 2),
pos AS (SELECT * FROM rb WHERE contribution > 0 AND base_feature IN ({', '.join(f"'{b}'" for b in ACTIONABLE)})),
sig AS (SELECT {KEY}, (SELECT p2.base_feature FROM pos p2 WHERE p2.{KEY} = pos.{KEY}
               ORDER BY p2.contribution DESC, p2.base_feature DESC LIMIT 1) AS top_feature,
               SUM(contribution) AS signal_sum, MAX(contribution) AS top_value FROM pos GROUP BY {KEY}),
mmed AS (SELECT quantile_cont(monthly_charges, 0.5) AS med FROM scored),
full_ AS (SELECT scored.{KEY}, scored.score,
            LEAST(GREATEST(COALESCE(monthly_charges, med) * {d(24.0)}, {d(100.0)}), {d(100000.0)}) AS clv
          FROM scored, mmed),
qg AS (SELECT quantile_cont(clv, 0.33) AS p33, quantile_cont(clv, 0.66) AS p66 FROM full_),
pool0 AS (SELECT *, ROW_NUMBER() OVER (ORDER BY score DESC, {KEY}) AS pool_pos FROM full_
          ORDER BY score DESC, {KEY} LIMIT {P.POOL_SIZE}),
pj AS (SELECT pool0.*, top.base_feature AS int_feature, top.implementation_cost AS int_cost,
              top.prob_reduction AS int_pr, top.value_saved AS int_saved0,
              sig.top_feature, sig.signal_sum, sig.top_value,
              CASE WHEN clv <= p33 THEN {d(30.0)} WHEN clv <= p66 THEN {d(50.0)} ELSE {d(75.0)} END AS gcost,
              LEAST(GREATEST(score * {d(0.30)}, {d(0.0)}), {d(1.0)}) AS gpr
       FROM pool0 LEFT JOIN top ON top.{KEY} = pool0.{KEY} AND top.action_rank = 1
       LEFT JOIN sig ON sig.{KEY} = pool0.{KEY}, qg),
pk AS (SELECT *, gpr * clv * {d(0.35)} * {d(0.65)} AS gsaved,
              int_feature IS NOT NULL AND int_feature NOT IN ({IMM_SQL}) AS int_act,
              top_feature IS NOT NULL AND top_feature NOT IN ({IMM_SQL}) AS shap_act,
              CASE WHEN int_saved0 > 0 THEN int_saved0 ELSE COALESCE(int_pr, {d(0.0)}) * clv END AS isaved,
              COALESCE(int_cost, {d(0.0)}) AS icost FROM pj),
pool AS (SELECT {KEY}, pool_pos, {rhu('score', 6)} AS pred_only_score, {rhu('score * clv', 6)} AS pred_clv_score,
           {rhu('gpr', 6)} AS generic_prob_reduction, {rhu('gsaved', 2)} AS generic_value_saved,
           {rhu('gsaved - gcost', 2)} AS generic_net_benefit,
           {rhu(f'CASE WHEN gcost > 0 THEN gsaved / gcost ELSE {d(0.0)} END', 4)} AS generic_roi,
           CASE WHEN shap_act THEN 1 ELSE 0 END AS shap_actionable,
           {rhu(f'CASE WHEN shap_act THEN score * GREATEST(COALESCE(signal_sum, {d(0.0)}), COALESCE(top_value, {d(0.0)})) ELSE {d(0.0)} END', 6)} AS shap_signal_score,
           CASE WHEN int_act THEN 1 ELSE 0 END AS integrated_actionable,
           {rhu(f'COALESCE(int_pr, {d(0.0)})', 6)} AS integrated_prob_reduction,
           {rhu(f'CASE WHEN int_act THEN isaved ELSE {d(0.0)} END', 2)} AS integrated_value_saved,
           CASE WHEN int_act THEN {rhu('isaved - icost', 2)} END AS integrated_net_benefit,
           {rhu(f'CASE WHEN int_act AND icost > 0 THEN isaved / icost ELSE {d(0.0)} END', 4)} AS integrated_roi
         FROM pk),
arms AS ({_arm_sql('pool', 'pool_pos, ')}),
sel AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY arm ORDER BY arm_score DESC, pool_pos) AS r
                       FROM arms) t WHERE r <= {P.BUDGET}),
pn AS (SELECT COUNT(*) AS n FROM pool),
draws AS (SELECT range // n AS seed, range % n AS draw,
                 {P.sql_mix32(f'((range // n) * 1000003 + range % n)')} % n + 1 AS pool_pos
          FROM range(0, {P.BOOTSTRAP} * (SELECT n FROM pn)), pn),
bsel AS (SELECT * FROM (SELECT d.seed, d.draw, a.*, ROW_NUMBER() OVER (PARTITION BY d.seed, a.arm
                          ORDER BY a.arm_score DESC, d.draw) AS r
                        FROM draws d JOIN arms a ON a.pool_pos = d.pool_pos) t WHERE r <= {P.BUDGET}),
bagg AS (SELECT seed, arm, COUNT(*) AS selected_customers, SUM(net) AS total_net_benefit,
                SUM(value) AS total_value_saved, AVG(roi) AS avg_roi, AVG(pr) AS avg_prob_reduction
         FROM bsel GROUP BY seed, arm),
grid AS (SELECT s.seed, a.arm FROM (SELECT DISTINCT range AS seed FROM range(0, {P.BOOTSTRAP})) s
         CROSS JOIN (VALUES {ARMS_LIST_SQL}) a(arm)),
boot AS (SELECT g.seed, g.arm, COALESCE(selected_customers, 0) AS selected_customers,
                COALESCE(total_net_benefit, 0) AS total_net_benefit, COALESCE(total_value_saved, 0) AS total_value_saved,
                COALESCE(avg_roi, 0) AS avg_roi, COALESCE(avg_prob_reduction, 0) AS avg_prob_reduction
         FROM grid g LEFT JOIN bagg b ON b.seed = g.seed AND b.arm = g.arm)"""


# ------------------------------------------------------------------ queries
@register("policy_ab", f"{EV1_SQL}\nSELECT {EV1_COLS} FROM ev1t")
def q_policy_ab(spark, sf_dir):
    return ev1(spark, sf_dir).select(*[c.strip() for c in EV1_COLS.split(",")])


@register("policy_ab_segments", f"""{EV1_SQL}
SELECT rfm_segment, COUNT(*) AS count, {rhu('AVG(churn_prob)', 3)} AS avg_churn_prob,
  {rhu('AVG(roi_b)', 3)} AS avg_roi, {rhu(f'AVG(COALESCE(cost_b, {d(0.0)}))', 3)} AS avg_cost,
  {rhu(f'AVG(COALESCE(prob_reduction, {d(0.0)}))', 3)} AS avg_prob_reduction
FROM ev1t GROUP BY rfm_segment""")
def q_policy_ab_segments(spark, sf_dir):
    return P.ev1_segments(ev1(spark, sf_dir))


@register("policy_headline", f"""{EV1_SQL},
k AS (SELECT GREATEST(1, CAST(FLOOR(COUNT(*) * {d(0.2)}) AS BIGINT)) AS k FROM ev1t),
ra AS (SELECT {KEY} FROM (SELECT {KEY}, ROW_NUMBER() OVER (ORDER BY churn_prob DESC, {KEY}) AS r FROM ev1t) t, k WHERE r <= k),
rb AS (SELECT {KEY} FROM (SELECT {KEY}, ROW_NUMBER() OVER (ORDER BY roi_b DESC, {KEY}) AS r FROM ev1t) t, k WHERE r <= k),
ov AS (SELECT COUNT(*) / CAST((SELECT k FROM k) AS DOUBLE) AS overlap FROM ra WHERE {KEY} IN (SELECT {KEY} FROM rb)),
s AS (SELECT COUNT(*) AS total_high_risk_customers, AVG(b_actionable) AS ab, SUM(net_a) AS ta, SUM(net_b) AS tb,
             COUNT(*) FILTER (WHERE roi_b > 1) AS customers_with_positive_roi,
             AVG(COALESCE(prob_reduction, {d(0.0)})) AS apr FROM ev1t)
SELECT total_high_risk_customers, {rhu('ab', 4)} AS actionability_rate_b, {rhu('overlap', 4)} AS top20_priority_overlap,
  {rhu('ta', 2)} AS total_retention_value_a, {rhu('tb', 2)} AS total_retention_value_b,
  {rhu(f'(tb - ta) / GREATEST(ABS(ta), {d(1.0)}) * {d(100.0)}', 2)} AS value_improvement_pct,
  customers_with_positive_roi, {rhu('apr', 4)} AS avg_prob_reduction FROM s, ov""")
def q_policy_headline(spark, sf_dir):
    return P.ev1_headline(ev1(spark, sf_dir), KEY)


@register("candidate_pool", f"{EV2_SQL}\nSELECT * FROM pool")
def q_candidate_pool(spark, sf_dir):
    return ev2_pool(spark, sf_dir)


@register("budget_selection", f"""{EV2_SQL}
SELECT pool_pos, {KEY}, arm, arm_score, net, value, roi, pr FROM sel""")
def q_budget_selection(spark, sf_dir):
    rows = P.arm_rows(ev2_pool(spark, sf_dir), extra=["pool_pos"])
    return P.select_budget(rows, P.BUDGET, ["arm"], ["pool_pos"])


@register("policy_arms", f"""{EV2_SQL},
integ AS (SELECT {KEY} FROM sel WHERE arm = 'Integrated AI + SHAP'),
ni AS (SELECT GREATEST(COUNT(*), 1) AS n FROM integ)
SELECT arm, COUNT(*) AS selected_customers, {rhu('SUM(value)', 2)} AS total_value_saved,
  {rhu('SUM(net)', 2)} AS total_net_benefit, {rhu('AVG(roi)', 4)} AS avg_roi,
  {rhu('AVG(pr)', 4)} AS avg_prob_reduction, {rhu('AVG(CAST(roi > 1 AS DOUBLE))', 4)} AS positive_roi_rate,
  {rhu(f'COUNT(*) FILTER (WHERE {KEY} IN (SELECT {KEY} FROM integ)) / CAST((SELECT n FROM ni) AS DOUBLE)', 4)}
    AS selection_overlap_vs_integrated
FROM sel GROUP BY arm""")
def q_policy_arms(spark, sf_dir):
    rows = P.arm_rows(ev2_pool(spark, sf_dir), extra=["pool_pos"])
    return P.arm_summary(P.select_budget(rows, P.BUDGET, ["arm"], ["pool_pos"]))


def boot(spark, sf_dir):
    return kept_small(spark, ("boot", sf_dir), lambda: P.bootstrap_arms(spark, ev2_pool(spark, sf_dir)))


@register("policy_bootstrap", f"""{EV2_SQL}
SELECT arm, {rhu('AVG(total_net_benefit)', 4)} AS mean_total_net_benefit,
  {rhu('STDDEV_SAMP(total_net_benefit)', 4)} AS std_total_net_benefit,
  {rhu('quantile_cont(total_net_benefit, 0.025)', 4)} AS ci_low_total_net_benefit,
  {rhu('quantile_cont(total_net_benefit, 0.975)', 4)} AS ci_high_total_net_benefit,
  {rhu('AVG(avg_roi)', 4)} AS mean_avg_roi, {rhu('AVG(avg_prob_reduction)', 4)} AS mean_avg_prob_reduction
FROM boot GROUP BY arm""")
def q_policy_bootstrap(spark, sf_dir):
    return P.bootstrap_summary(boot(spark, sf_dir))


def _pairwise_sql():
    p = S.sql_two_sided_p("z")
    return f"""{EV2_SQL},
x AS (SELECT b.arm AS baseline, i.total_net_benefit - b.total_net_benefit AS diff,
             CASE WHEN b.total_net_benefit <> 0 THEN (i.total_net_benefit - b.total_net_benefit)
                  / b.total_net_benefit * {d(100.0)} END AS imp,
             {rhu('i.total_net_benefit - b.total_net_benefit', P.RANKED_PLACES)} AS ranked
      FROM boot i JOIN boot b ON i.seed = b.seed
      WHERE i.arm = 'Integrated AI + SHAP' AND b.arm <> 'Integrated AI + SHAP'),
nz AS (SELECT baseline, ranked, ABS(ranked) AS size,
              RANK() OVER (PARTITION BY baseline ORDER BY ABS(ranked)) AS first_rank,
              COUNT(*) OVER (PARTITION BY baseline, ABS(ranked)) AS t
       FROM x WHERE ranked <> 0),
w AS (SELECT baseline, COUNT(*) AS n, SUM(CAST(t AS DOUBLE) * t - 1) AS ties,
             SUM(CASE WHEN ranked > 0 THEN first_rank + (t - 1) / {d(2.0)} ELSE {d(0.0)} END) AS w_plus,
             SUM(CASE WHEN ranked < 0 THEN first_rank + (t - 1) / {d(2.0)} ELSE {d(0.0)} END) AS w_minus
      FROM nz GROUP BY baseline),
z AS (SELECT baseline, n, LEAST(w_plus, w_minus) AS statistic,
             (LEAST(w_plus, w_minus) - CAST(n AS DOUBLE) * (n + 1) / {d(4.0)})
             / SQRT(CAST(n AS DOUBLE) * (n + 1) * (2 * n + 1) / {d(24.0)} - ties / {d(48.0)}) AS z FROM w),
s AS (SELECT baseline, COUNT(*) AS n_pairs, {rhu('AVG(diff)', 4)} AS mean_net_benefit_diff,
  {rhu(f'COALESCE(quantile_cont(imp, 0.5), {d(0.0)})', 4)} AS median_value_improvement_pct,
  {rhu(f'COALESCE(quantile_cont(imp, 0.025), {d(0.0)})', 4)} AS ci_low_value_improvement_pct,
  {rhu(f'COALESCE(quantile_cont(imp, 0.975), {d(0.0)})', 4)} AS ci_high_value_improvement_pct,
  {rhu(f'CASE WHEN STDDEV_SAMP(diff) > {d(1e-9)} THEN AVG(diff) / STDDEV_SAMP(diff) ELSE {d(0.0)} END', 4)} AS cohens_d
  FROM x GROUP BY baseline)
SELECT s.*, COALESCE(n, 0) AS n_nonzero,
  CASE WHEN n_pairs >= 10 AND n > 0 THEN {rhu('statistic', 4)} END AS wilcoxon_statistic,
  CASE WHEN n_pairs >= 10 AND n > 0 THEN {rhu(p, 6)} END AS wilcoxon_p_value,
  CASE WHEN n_pairs >= 10 AND n > 0 THEN {rhu(p, 6)} < {d(0.05)} END AS significant_at_005
FROM s LEFT JOIN z USING (baseline)"""


@register("policy_pairwise", _pairwise_sql())
def q_policy_pairwise(spark, sf_dir):
    return P.pairwise(boot(spark, sf_dir))


@register("policy_gain", f"""{EV2_SQL},
t AS (SELECT arm, SUM(net) AS tn FROM sel GROUP BY arm)
SELECT b.arm AS baseline, (i.tn - b.tn) / GREATEST(ABS(b.tn), {d(1.0)}) * {d(100.0)} AS gain_pct
FROM t i JOIN t b ON i.arm = 'Integrated AI + SHAP' AND b.arm <> 'Integrated AI + SHAP'""")
def q_policy_gain(spark, sf_dir):
    """Percent gain of the integrated arm over each baseline (AG16)."""
    rows = P.arm_rows(ev2_pool(spark, sf_dir), extra=["pool_pos"])
    t = P.select_budget(rows, P.BUDGET, ["arm"], ["pool_pos"]).groupBy("arm") \
        .agg(F.sum("net").alias("tn"))
    pv = t.groupBy().pivot("arm", P.ARMS).agg(F.first("tn"))
    i = F.col("`Integrated AI + SHAP`")
    parts = [pv.select(F.lit(b).alias("baseline"),
                       ((i - F.col(f"`{b}`")) / F.greatest(F.abs(F.col(f"`{b}`")), F.lit(1.0))
                        * 100.0).alias("gain_pct")).where(F.col(f"`{b}`").isNotNull())
             for b in P.ARMS[:3]]
    out = parts[0]
    for p_ in parts[1:]:
        out = out.unionByName(p_)
    return out


# ------------------------------------------------------------------ statistics
@register("stat_spearman", f"""{EV1_SQL},
r AS (SELECT (RANK() OVER (ORDER BY churn_prob DESC) + (COUNT(*) OVER (PARTITION BY churn_prob) - 1) / {d(2.0)}) AS ra,
             (RANK() OVER (ORDER BY roi_b DESC) + (COUNT(*) OVER (PARTITION BY roi_b) - 1) / {d(2.0)}) AS rb FROM ev1t)
SELECT COUNT(*) AS n, corr(ra, rb) AS rho FROM r""")
def q_stat_spearman(spark, sf_dir):
    return S.spearman(ev1(spark, sf_dir), "churn_prob", "roi_b")


@register("average_rank", f"""{EV1_SQL}
SELECT {KEY}, roi_b, RANK() OVER (ORDER BY roi_b DESC) + (COUNT(*) OVER (PARTITION BY roi_b) - 1) / {d(2.0)} AS roi_rank
FROM ev1t""")
def q_average_rank(spark, sf_dir):
    """Average-tie rank, descending (WN3)."""
    return S.average_rank(ev1(spark, sf_dir).select(KEY, "roi_b"), "roi_b", "roi_rank", descending=True)


@register("stat_wilcoxon", f"""{EV1_SQL},
nz AS (SELECT net_b - net_a AS d, ABS(net_b - net_a) AS ad FROM ev1t WHERE net_b - net_a <> 0),
rk AS (SELECT d, RANK() OVER (ORDER BY ad) + (COUNT(*) OVER (PARTITION BY ad) - 1) / {d(2.0)} AS r FROM nz),
tt AS (SELECT SUM(CAST(t AS DOUBLE) * t * t - t) AS tt FROM (SELECT COUNT(*) AS t FROM nz GROUP BY ad) g),
w AS (SELECT COUNT(*) AS n, SUM(CASE WHEN d > 0 THEN r ELSE {d(0.0)} END) AS w_plus,
             SUM(CASE WHEN d < 0 THEN r ELSE {d(0.0)} END) AS w_minus FROM rk),
z AS (SELECT n, w_plus, w_minus, LEAST(w_plus, w_minus) AS statistic,
  (LEAST(w_plus, w_minus) - CAST(n AS DOUBLE) * (n + 1) / {d(4.0)})
   / SQRT(CAST(n AS DOUBLE) * (n + 1) * (2 * n + 1) / {d(24.0)} - tt / {d(48.0)}) AS z FROM w, tt)
SELECT *, {rhu(S.sql_two_sided_p('z'), 6)} AS p_value, n >= 10 AS tested,
  n >= 10 AND {S.sql_two_sided_p('z')} < {d(0.05)} AS significant FROM z""")
def q_stat_wilcoxon(spark, sf_dir):
    t = ev1(spark, sf_dir).withColumn("diff", F.col("net_b") - F.col("net_a"))
    return S.wilcoxon(t, "diff")


@register("stat_mannwhitney", f"""{EV1_SQL},
rk AS (SELECT rfm_segment, RANK() OVER (ORDER BY roi_b) + (COUNT(*) OVER (PARTITION BY roi_b) - 1) / {d(2.0)} AS r FROM ev1t),
tt AS (SELECT SUM(CAST(t AS DOUBLE) * t * t - t) AS tt FROM (SELECT COUNT(*) AS t FROM ev1t GROUP BY roi_b) g),
na AS (SELECT CAST(COUNT(*) AS DOUBLE) AS n FROM ev1t),
g AS (SELECT rfm_segment, COUNT(*) AS n_segment, SUM(r) AS r1 FROM rk GROUP BY rfm_segment),
z AS (SELECT rfm_segment, n_segment, CAST(n - n_segment AS BIGINT) AS n_rest,
  r1 - n_segment * (n_segment + 1) / {d(2.0)} AS u_statistic,
  (ABS(r1 - n_segment * (n_segment + 1) / {d(2.0)} - n_segment * (n - n_segment) / {d(2.0)}) - {d(0.5)})
   / SQRT(n_segment * (n - n_segment) / {d(12.0)} * ((n + 1) - tt / (n * (n - 1)))) AS z,
  n_segment >= 3 AND n - n_segment >= 3 AS tested
FROM g, na, tt)
SELECT *, {rhu(S.sql_two_sided_p('z'), 6)} AS p_value,
  tested AND {S.sql_two_sided_p('z')} < {d(0.05)} AS significant FROM z""")
def q_stat_mannwhitney(spark, sf_dir):
    return S.mann_whitney(ev1(spark, sf_dir), "roi_b", "rfm_segment")


@register("stat_cohens_d", f"""{EV1_SQL},
s AS (SELECT AVG(net_b - net_a) AS mean_diff, SQRT((VAR_SAMP(net_a) + VAR_SAMP(net_b)) / {d(2.0)}) AS pooled_std FROM ev1t),
c AS (SELECT *, CASE WHEN pooled_std > 0 THEN mean_diff / pooled_std ELSE {d(0.0)} END AS cohens_d FROM s)
SELECT mean_diff, pooled_std, cohens_d,
  CASE WHEN ABS(cohens_d) >= {d(0.8)} THEN 'Large' WHEN ABS(cohens_d) >= {d(0.5)} THEN 'Medium'
       WHEN ABS(cohens_d) >= {d(0.2)} THEN 'Small' ELSE 'Negligible' END AS magnitude FROM c""")
def q_stat_cohens_d(spark, sf_dir):
    return S.cohens_d_pooled(ev1(spark, sf_dir), "net_a", "net_b")


@register("stat_normality", f"""{EV1_SQL},
x AS (SELECT COALESCE(prob_reduction, {d(0.0)}) AS v FROM ev1t WHERE COALESCE(prob_reduction, {d(0.0)}) <> 0),
m AS (SELECT AVG(v) AS mu, COUNT(*) AS n FROM x),
c AS (SELECT n, AVG((v - mu) * (v - mu)) AS m2, AVG((v - mu) * (v - mu) * (v - mu)) AS m3,
             AVG((v - mu) * (v - mu) * (v - mu) * (v - mu)) AS m4 FROM x, m GROUP BY n),
g AS (SELECT n, m3 / POW(m2, 1.5) AS skew, m4 / (m2 * m2) - 3 AS excess_kurtosis FROM c)
SELECT n, skew, excess_kurtosis, n / {d(6.0)} * (skew * skew + excess_kurtosis * excess_kurtosis / {d(4.0)}) AS jb,
  n / {d(6.0)} * (skew * skew + excess_kurtosis * excess_kurtosis / {d(4.0)}) < {d(S.JB_CRITICAL_95)} AS is_normal,
  n >= 8 AS tested FROM g""")
def q_stat_normality(spark, sf_dir):
    t = ev1(spark, sf_dir).withColumn("v", F.coalesce("prob_reduction", F.lit(0.0)))
    return S.jarque_bera(t, "v")
