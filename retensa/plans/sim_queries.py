"""What-if simulation queries (SIM1, AG8-AG11) with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import sql_round_half_up as rhu
from ..operators import simulate as SIM
from .action_queries import ATTR_SQL, BG_SQL, KEY, _terms
from .mart import cached
from .registry import register
from .scored import CATEGORY_COLUMNS, DUMMY_WEIGHTS, NUMERIC_WEIGHTS, SCORED_SQL, dummy_name, logit_sql
from .sqlgen import d


def sim_table(spark, sf_dir):
    def build():
        s, card, r, terms = _terms(spark, sf_dir)
        t3 = {}
        for f, (v, c) in terms.items():
            if f in NUMERIC_WEIGHTS:
                w = NUMERIC_WEIGHTS[f] / card.std[f]
            else:
                w = [wt for (cc, lv), wt in DUMMY_WEIGHTS.items() if dummy_name(cc, lv) == f][0]
            t3[f] = (v, c, w)
        vals = {c: F.col(c) for c in list(NUMERIC_WEIGHTS) + CATEGORY_COLUMNS}
        return SIM.simulate(s, KEY, t3, card.logit(vals), SIM.value_or_default(F.col("total_revenue")))
    return cached(spark, ("sim", sf_dir), build)


def _w_sql(f):
    if f in NUMERIC_WEIGHTS:
        return f"{d(NUMERIC_WEIGHTS[f])} / sc_stats.s_{f}"
    return d([wt for (c, lv), wt in DUMMY_WEIGHTS.items() if dummy_name(c, lv) == f][0])


_NONACT = ", ".join(f"'{x}'" for x in sorted(SIM.NON_ACTIONABLE))
_FEATS = list(NUMERIC_WEIGHTS) + [dummy_name(c, lv) for (c, lv) in DUMMY_WEIGHTS]
_WCASE = "CASE a.feature " + " ".join(f"WHEN '{f}' THEN {_w_sql(f)}" for f in _FEATS) + " END"
_TYPE = "CASE lower(trim(a.feature)) " + " ".join(
    f"WHEN '{k}' THEN '{v[0]}'" for k, v in SIM.TYPES.items()) + f" ELSE '{SIM.DEFAULT_TYPE[0]}' END"
_FEAS = "CASE lower(trim(a.feature)) " + " ".join(
    f"WHEN '{k}' THEN '{v[1]}'" for k, v in SIM.TYPES.items()) + f" ELSE '{SIM.DEFAULT_TYPE[1]}' END"
_COST = "CASE a.feature " + " ".join(
    f"WHEN '{f}' THEN {d(SIM.offer(f).cost)}" for f in _FEATS) + " END"
_LABEL = "CASE feature " + " ".join(f"WHEN '{f}' THEN '{SIM.label(f)}'" for f in _FEATS) + " END"
_VALS = {c: f"scored.{c}" for c in list(NUMERIC_WEIGHTS) + CATEGORY_COLUMNS}

SIM_SQL = f"""WITH {SCORED_SQL}, {BG_SQL}, {ATTR_SQL},
cnt AS (SELECT COUNT(*) FILTER (WHERE score BETWEEN {d(0.55)} AND {d(0.85)}) AS c FROM scored),
bnd AS (SELECT CASE WHEN c < 5 THEN {d(0.50)} ELSE {d(0.55)} END AS lo,
               CASE WHEN c < 5 THEN {d(0.90)} ELSE {d(0.85)} END AS hi FROM cnt),
b AS (SELECT scored.{KEY}, scored.score, {logit_sql(_VALS)} AS lg,
             CASE WHEN isfinite(total_revenue) AND total_revenue > 0 THEN total_revenue
                  ELSE {d(SIM.DEFAULT_CUSTOMER_VALUE)} END AS cv,
             ROW_NUMBER() OVER (ORDER BY scored.score, scored.{KEY}) AS br, COUNT(*) OVER () AS m
      FROM scored, sc_stats, bnd WHERE scored.score BETWEEN bnd.lo AND bnd.hi),
cut AS (SELECT quantile_cont(score, {d(0.3)}) AS cut FROM scored),
lowm AS (SELECT a.feature, quantile_cont(a.value, 0.5) AS lm FROM attr a JOIN scored USING ({KEY}), cut
         WHERE scored.score <= cut.cut GROUP BY a.feature),
fst AS (SELECT feature, MIN(value) AS lo, MAX(value) AS hi,
               BOOL_AND(value IS NULL OR value IN ({d(0.0)}, {d(1.0)})) AS isb FROM attr GROUP BY feature),
c0 AS (SELECT b.*, a.feature, a.contribution, a.value AS cur, fst.isb, lowm.lm, fst.lo AS flo, fst.hi AS fhi,
              {_WCASE} AS w, {_TYPE} AS itype, {_FEAS} AS feas, {_COST} AS cost
       FROM b JOIN attr a USING ({KEY}) JOIN fst USING (feature) JOIN lowm USING (feature), sc_stats
       WHERE a.contribution > 0 AND lower(trim(a.feature)) NOT IN ({_NONACT})),
c1 AS (SELECT *, CASE WHEN isb THEN CASE WHEN cur >= {d(0.5)} THEN {d(0.0)} ELSE {d(1.0)} END
                      ELSE {rhu(f'LEAST(GREATEST(cur + {d(0.3)} * (lm - cur), flo), fhi)', 2)} END AS sim,
              ROW_NUMBER() OVER (PARTITION BY {KEY} ORDER BY ABS(contribution) DESC, feature) AS rr FROM c0),
c2 AS (SELECT * FROM c1 WHERE rr <= 3 AND cur IS NOT NULL
         AND (isb OR (ABS(lm - cur) >= {d(1e-9)} AND ABS(sim - cur) >= {d(1e-9)}))),
c3 AS (SELECT *, LEAST(GREATEST({rhu(f'{d(1.0)} / ({d(1.0)} + EXP(-(lg + w * (sim - cur))))', 10)}, {d(0.0)}), {d(1.0)}) AS np_ FROM c2),
c4 AS (SELECT *, LEAST(GREATEST(score - np_, {d(0.0)}), {d(0.25)}) AS red,
              CASE feas WHEN 'High' THEN {d(0.85)} WHEN 'Medium' THEN {d(0.70)} ELSE {d(0.55)} END AS ex
       FROM c3),
c5 AS (SELECT *, {rhu(f'red * cv * {d(0.35)} * ex', 2)} AS saved FROM c4),
sim0 AS (SELECT {KEY},
  (br - 1) IN (0, CAST(FLOOR(1 * ((m - 1) / {d(4.0)})) AS BIGINT), CAST(FLOOR(2 * ((m - 1) / {d(4.0)})) AS BIGINT),
               CAST(FLOOR(3 * ((m - 1) / {d(4.0)})) AS BIGINT), m - 1) AS representative,
  {rhu('score', 4)} AS original_churn_probability, feature AS intervention_feature, {_LABEL} AS feature_label,
  {rhu('cur', 2)} AS original_value, {rhu('sim', 2)} AS simulated_value,
  {rhu('score - red', 4)} AS simulated_churn_probability, {rhu('red', 4)} AS probability_reduction,
  itype AS intervention_type, feas AS feasibility_level, {rhu('cost', 2)} AS intervention_cost,
  {rhu('cv', 2)} AS customer_value, saved AS value_saved,
  {rhu(f'CASE WHEN cost > 0 THEN saved / cost ELSE {d(0.0)} END', 4)} AS roi, {rhu('saved - cost', 2)} AS net_benefit,
  CASE WHEN red < {d(0.01)} THEN 'negligible' WHEN red < {d(0.05)} THEN 'modest'
       WHEN red < {d(0.15)} THEN 'moderate' ELSE 'notable' END AS impact,
  CAST(m AS BIGINT) AS band_size FROM c5),
sim AS (SELECT *, printf('%s: moving %s from %.2f to %.2f lowers the predicted churn probability by %.1f%% (%s). '
                         || 'An estimate by the model''s associations, no causal effect.',
                         intervention_type, lower(feature_label), original_value, simulated_value,
                         {rhu('probability_reduction * 100', 1)}, impact) AS message FROM sim0)"""


@register("sim_interventions", f"{SIM_SQL}\nSELECT * FROM sim")
def q_sim_interventions(spark, sf_dir):
    return sim_table(spark, sf_dir)


@register("sim_impact_summary", f"""{SIM_SQL}
SELECT MAX(band_size) AS customers_evaluated,
  COUNT(DISTINCT CASE WHEN probability_reduction > 0 THEN {KEY} END) AS customers_with_valid_intervention,
  COUNT(*) AS total_interventions,
  {rhu('AVG(original_churn_probability)', 4)} AS avg_original_churn_probability,
  {rhu('AVG(simulated_churn_probability)', 4)} AS avg_simulated_churn_probability,
  {rhu('AVG(probability_reduction)', 4)} AS avg_probability_reduction,
  {rhu('MAX(probability_reduction)', 4)} AS max_probability_reduction,
  {rhu('MIN(probability_reduction)', 4)} AS min_probability_reduction,
  {rhu('AVG(intervention_cost)', 2)} AS avg_intervention_cost, {rhu('AVG(customer_value)', 2)} AS avg_customer_value,
  {rhu('AVG(net_benefit)', 2)} AS avg_net_benefit, {rhu('AVG(roi)', 4)} AS avg_roi,
  COUNT(*) FILTER (WHERE net_benefit > 0) AS number_positive_roi,
  COUNT(*) FILTER (WHERE net_benefit < 0) AS number_negative_roi FROM sim""")
def q_sim_impact_summary(spark, sf_dir):
    return SIM.impact_summary(sim_table(spark, sf_dir), KEY)


@register("sim_by_type", f"""{SIM_SQL},
g AS (SELECT intervention_type, AVG(roi) AS ar, AVG(net_benefit) AS an, COUNT(*) AS interventions FROM sim GROUP BY 1)
SELECT intervention_type, {rhu('ar', 4)} AS avg_roi, {rhu('an', 2)} AS avg_net_benefit, interventions,
  intervention_type = (SELECT intervention_type FROM g ORDER BY ar DESC, intervention_type DESC LIMIT 1) AS is_best,
  intervention_type = (SELECT intervention_type FROM g ORDER BY ar ASC, intervention_type ASC LIMIT 1) AS is_worst
FROM g""")
def q_sim_by_type(spark, sf_dir):
    return SIM.by_type(sim_table(spark, sf_dir))


@register("sim_customer_best", f"""{SIM_SQL}
SELECT {KEY}, MAX(probability_reduction) AS best_reduction, COUNT(*) AS n_actions FROM sim GROUP BY {KEY}""")
def q_sim_customer_best(spark, sf_dir):
    return SIM.customer_best(sim_table(spark, sf_dir), KEY)
