"""Attribution, low-risk profile, drivers, scenarios, priced actions, CLV and
value tiers on the scored table, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import sql_round_half_up as rhu
from ..operators import actions as A
from ..operators import explain as X
from .mart import MART_COLUMNS, cached
from .registry import register
from .scored import (CATEGORY_COLUMNS, DUMMY_WEIGHTS, INTERCEPT, NUMERIC_WEIGHTS, SCORED_SQL,
                     build_scored, dummy_name, prob_sql, scorecard)
from .sqlgen import d

KEY = "customer_id"
NUMERIC = list(NUMERIC_WEIGHTS)
INPUTS = NUMERIC + CATEGORY_COLUMNS
FEATURES = NUMERIC + [dummy_name(c, lv) for (c, lv) in DUMMY_WEIGHTS]
RAW_COLS = [c for c in MART_COLUMNS if c not in (KEY, "churn")]
LINEAGE = X.lineage(FEATURES, RAW_COLS)
ACTIONABLE = [b for b in INPUTS if X.is_actionable(b, [KEY])]
WS = f"WITH {SCORED_SQL}"


# ------------------------------------------------------------------ Spark side
def _background(spark, sf_dir):
    s, card = build_scored(spark, sf_dir), scorecard(spark, sf_dir)
    r = s.agg(*[F.avg(card.z(c, F.col(c))).alias(f"z_{c}") for c in NUMERIC],
              *[F.avg(F.coalesce((F.col(c) == lv).cast("double"), F.lit(0.0)))
                .alias(f"i_{i}") for i, (c, lv) in enumerate(DUMMY_WEIGHTS)]).first()
    return s, card, r


def _terms(spark, sf_dir):
    """feature -> (value, contribution) with contribution = w * (x - background)."""
    s, card, r = _background(spark, sf_dir)
    terms = {}
    for c, w in NUMERIC_WEIGHTS.items():
        terms[c] = (F.col(c).cast("double"),
                    F.lit(w) * (card.z(c, F.col(c)) - F.lit(r[f"z_{c}"])))
    for i, ((c, lv), w) in enumerate(DUMMY_WEIGHTS.items()):
        ind = F.coalesce((F.col(c) == lv).cast("double"), F.lit(0.0))
        terms[dummy_name(c, lv)] = (ind, F.lit(w) * (ind - F.lit(r[f"i_{i}"])))
    return s, card, r, terms


def base_contributions(terms):
    out = {}
    for f, (_, c) in terms.items():
        b = LINEAGE[f]
        out[b] = c if b not in out else out[b] + c
    return out


def linear_attribution(spark, sf_dir):
    s, _, _, terms = _terms(spark, sf_dir)
    return X.long_attribution(s, KEY, terms)


def _profile(spark, sf_dir):
    s = build_scored(spark, sf_dir)
    return s, A.fit_low_risk_profile(s, KEY, NUMERIC, CATEGORY_COLUMNS)


def driver_table(spark, sf_dir):
    s, _, _, terms = _terms(spark, sf_dir)
    prof = A.fit_low_risk_profile(s, KEY, NUMERIC, CATEGORY_COLUMNS)
    return s, prof, A.drivers(s, KEY, base_contributions(terms), prof, ACTIONABLE)


def scenario_table(spark, sf_dir):
    s, prof, drv = driver_table(spark, sf_dir)
    return s, A.scenarios(drv, KEY, prof)


def priced(spark, sf_dir, people):
    """Priced scenarios of ``people`` against the low-risk profile of everyone."""
    _, prof = _profile(spark, sf_dir)
    drv = A.drivers(people, KEY, base_contributions(_terms(spark, sf_dir)[3]), prof, ACTIONABLE)
    return A.action_values(A.scenarios(drv, KEY, prof), people, KEY, scorecard(spark, sf_dir).prob,
                           INPUTS, NUMERIC)


def value_table(spark, sf_dir):
    """Priced scenarios for every customer; persisted once per application
    because the policy evaluations all start from it."""
    def build():
        s, sc = scenario_table(spark, sf_dir)
        card = scorecard(spark, sf_dir)
        return A.action_values(sc, s, KEY, card.prob, INPUTS, NUMERIC)
    return cached(spark, ("action_values", sf_dir), build)


# ------------------------------------------------------------------ SQL side
def _z_sql(c, src="scored"):
    return f"COALESCE(({src}.{c} - sc_stats.m_{c}) / sc_stats.s_{c}, {d(0.0)})"


def _ind_sql(c, lv, src="scored"):
    return f"COALESCE(CAST({src}.{c} = '{lv}' AS DOUBLE), {d(0.0)})"


BG_SQL = "bg AS (SELECT " + ", ".join(
    [f"AVG({_z_sql(c)}) AS z_{c}" for c in NUMERIC]
    + [f"AVG({_ind_sql(c, lv)}) AS i_{i}" for i, (c, lv) in enumerate(DUMMY_WEIGHTS)]
) + " FROM scored, sc_stats)"


def _terms_sql():
    out = {}
    for c, w in NUMERIC_WEIGHTS.items():
        out[c] = (f"CAST(scored.{c} AS DOUBLE)", f"{d(w)} * ({_z_sql(c)} - bg.z_{c})")
    for i, ((c, lv), w) in enumerate(DUMMY_WEIGHTS.items()):
        out[dummy_name(c, lv)] = (_ind_sql(c, lv), f"{d(w)} * ({_ind_sql(c, lv)} - bg.i_{i})")
    return out


ATTR_SQL = "attr AS (" + "\nUNION ALL ".join(
    f"SELECT scored.{KEY}, '{f}' AS feature, {v} AS value, {c} AS contribution "
    f"FROM scored, sc_stats, bg" for f, (v, c) in _terms_sql().items()) + ")"


def _base_contrib_sql():
    out = {}
    for f, (_, c) in _terms_sql().items():
        b = LINEAGE[f]
        out[b] = c if b not in out else f"({out[b]} + {c})"
    return out


LOW_SQL = f"""nn AS (SELECT COUNT(*) AS n FROM scored),
low AS (SELECT * FROM (SELECT scored.*, ROW_NUMBER() OVER (ORDER BY score, {KEY}) AS rr FROM scored) t, nn
        WHERE rr <= LEAST(n, GREATEST(30, CAST(FLOOR(n * {d(0.3)}) AS BIGINT))))"""


def _prof_sql():
    parts = []
    for c in NUMERIC:
        parts.append(
            f"SELECT '{c}' AS base_feature, 'numeric' AS kind, "
            f"COALESCE((SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) FROM low), quantile_cont(CAST({c} AS DOUBLE), 0.5)) AS low_median, "
            f"CAST(NULL AS VARCHAR) AS low_mode, STDDEV_SAMP(CAST({c} AS DOUBLE)) AS overall_std, "
            f"CAST(MIN({c}) AS DOUBLE) AS overall_min, CAST(MAX({c}) AS DOUBLE) AS overall_max, "
            f"COUNT({c}) AS valid_count, AVG(CAST({c} IS NOT NULL AS DOUBLE)) AS share, "
            f"quantile_cont(CAST({c} AS DOUBLE), 0.35) AS q35, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS q50, "
            f"quantile_cont(CAST({c} AS DOUBLE), 0.65) AS q65 FROM scored")
    for c in CATEGORY_COLUMNS:
        parts.append(
            f"SELECT '{c}', 'categorical', NULL, (SELECT COALESCE(CAST({c} AS VARCHAR), 'None') FROM low "
            f"GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL")
    return "prof AS (" + "\nUNION ALL ".join(parts) + ")"


LEVELS_SQL = "lowc AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS base, level, ROW_NUMBER() OVER (ORDER BY cnt DESC, level) AS pos FROM "
    f"(SELECT COALESCE(CAST({c} AS VARCHAR), 'None') AS level, COUNT(*) AS cnt FROM low GROUP BY 1) t"
    for c in CATEGORY_COLUMNS) + "),\nglobc AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS base, level, ROW_NUMBER() OVER (ORDER BY cnt DESC, level) AS pos FROM "
    f"(SELECT COALESCE(CAST({c} AS VARCHAR), 'None') AS level, COUNT(*) AS cnt FROM scored GROUP BY 1) t"
    for c in CATEGORY_COLUMNS) + ")"


def _drivers_sql():
    contrib = _base_contrib_sql()
    parts = []
    for b in ACTIONABLE:
        if b in NUMERIC:
            dev = (f"CASE WHEN scored.{b} IS NOT NULL AND p.share >= {d(0.8)} THEN "
                   f"ABS(scored.{b} - p.low_median) / CASE WHEN p.overall_std > {d(1e-9)} "
                   f"THEN p.overall_std ELSE {d(1.0)} END ELSE {d(1.0)} END")
            cur_n, cur_t = f"CAST(scored.{b} AS DOUBLE)", "CAST(NULL AS VARCHAR)"
        else:
            cur_n = "CAST(NULL AS DOUBLE)"
            cur_t = f"COALESCE(CAST(scored.{b} AS VARCHAR), 'None')"
            dev = f"CASE WHEN {cur_t} <> p.low_mode THEN {d(1.0)} ELSE {d(0.0)} END"
        parts.append(f"SELECT scored.{KEY}, '{b}' AS base_feature, {contrib[b]} AS contribution, "
                     f"{cur_n} AS current_num, {cur_t} AS current_text, {dev} AS deviation "
                     f"FROM scored, sc_stats, bg, prof p WHERE p.base_feature = '{b}'")
    return f"""dall AS ({' UNION ALL '.join(parts)}),
dpos AS (SELECT *, COUNT(*) FILTER (WHERE deviation > {d(0.15)}) OVER (PARTITION BY {KEY}) AS np
         FROM dall WHERE contribution > 0),
drv AS (SELECT * FROM (SELECT {KEY}, base_feature, contribution, current_num, current_text, deviation,
           ROW_NUMBER() OVER (PARTITION BY {KEY} ORDER BY ABS(contribution) DESC, base_feature) AS driver_rank
         FROM dpos WHERE np < 2 OR deviation > {d(0.15)}) t WHERE driver_rank <= 3)"""


def _scen_sql():
    moves = " UNION ALL ".join(
        f"SELECT drv.*, {i + 1} AS raw_order, '{n}' AS scenario_name, "
        f"CASE WHEN ABS(p.low_median - current_num) > {d(1e-9)} THEN "
        f"LEAST(GREATEST(current_num + {d(f)} * (p.low_median - current_num), p.overall_min), p.overall_max) "
        f"ELSE p.q{int(qq * 100)} END AS new_value_num, CAST(NULL AS VARCHAR) AS new_value_text "
        f"FROM drv JOIN prof p USING (base_feature) WHERE p.kind = 'numeric' AND p.valid_count >= 15"
        for i, ((f, n), (qq, _)) in enumerate(zip(A.MOVE_FRACTIONS, A.FALLBACK_QUANTILES)))
    return f"""nm0 AS (SELECT * FROM ({moves}) t
   WHERE ABS(new_value_num - current_num) > {d(1e-9)} OR ABS((SELECT low_median FROM prof WHERE prof.base_feature = t.base_feature) - current_num) > {d(1e-9)}),
nm1 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY {KEY}, base_feature ORDER BY raw_order) AS scenario_order FROM nm0),
nm AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {KEY}, base_feature, {rhu('new_value_num', 6)}
                        ORDER BY scenario_order) AS dup FROM nm1) t WHERE dup = 1),
cc AS (SELECT drv.*, l.level, 0 AS src, l.pos FROM drv JOIN lowc l ON l.base = drv.base_feature AND l.level <> drv.current_text
       UNION ALL
       SELECT drv.*, g.level, 1 AS src, g.pos FROM drv JOIN globc g ON g.base = drv.base_feature AND g.level <> drv.current_text
       WHERE NOT EXISTS (SELECT 1 FROM lowc l2 WHERE l2.base = drv.base_feature AND l2.level = g.level)),
cc2 AS (SELECT *, COUNT(*) FILTER (WHERE src = 0) OVER (PARTITION BY {KEY}, base_feature) AS nlow FROM cc),
cm AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {KEY}, base_feature ORDER BY src, pos) AS scenario_order
        FROM cc2 WHERE src = 0 OR nlow < 2) t WHERE scenario_order <= 3),
scen AS (SELECT {KEY}, base_feature, contribution, current_num, current_text, deviation, driver_rank,
                scenario_order, scenario_name, new_value_num, new_value_text FROM nm
         UNION ALL
         SELECT {KEY}, base_feature, contribution, current_num, current_text, deviation, driver_rank,
                scenario_order, 'Option' || CAST(scenario_order AS VARCHAR), CAST(NULL AS DOUBLE), level FROM cm)"""


def _clv_sql(src="scored"):
    cols = [c for c in MART_COLUMNS if any(k in c.lower() for k in A.CLV_REVENUE_KEYWORDS)]
    whens = " ".join(f"WHEN {src}.{c} >= 10 AND {src}.{c} <= 10000 THEN {src}.{c} * {d(24.0)}"
                     for c in cols)
    return f"CASE {whens} ELSE {d(A.DEFAULT_CLV)} END"


def _values_sql():
    vals = {}
    for c in INPUTS:
        new = "scen.new_value_num" if c in NUMERIC else "scen.new_value_text"
        vals[c] = f"(CASE WHEN scen.base_feature = '{c}' THEN {new} ELSE scored.{c} END)"
    newp = f"LEAST(GREATEST({prob_sql(vals)}, {d(0.0)}), {d(1.0)})"
    orig = f"LEAST(GREATEST(scored.score, {d(0.0)}), {d(1.0)})"
    feas = {b: A.feasibility(b) for b in INPUTS}
    fscore = "CASE scen.base_feature " + " ".join(f"WHEN '{b}' THEN {feas[b][0]}" for b in INPUTS) + " END"
    fexec = "CASE scen.base_feature " + " ".join(
        f"WHEN '{b}' THEN {d(A.execution_probability(feas[b][1]))}" for b in INPUTS) + " END"
    cost = "CASE scen.base_feature " + " ".join(
        f"WHEN '{b}' THEN {d(A.intervention_cost(b))}" for b in INPUTS) + " END"
    return f"""av0 AS (SELECT scen.*, {newp} AS np_, {orig} AS op_, {_clv_sql()} AS clv_,
                {fscore} AS feasibility_score, {fexec} AS ex_, {cost} AS cost_
         FROM scen JOIN scored USING ({KEY}), sc_stats),
av1 AS (SELECT *, GREATEST({d(0.0)}, op_ - np_) AS red_ FROM av0),
av AS (SELECT {KEY}, base_feature, driver_rank, scenario_order, scenario_name, current_num, current_text,
         new_value_num, new_value_text,
         {rhu('np_', 6)} AS predicted_churn_prob, {rhu('op_', 6)} AS original_churn_prob,
         {rhu('red_', 6)} AS prob_reduction, feasibility_score, {rhu('cost_', 2)} AS implementation_cost,
         {rhu('clv_', 2)} AS customer_clv, {rhu(f'red_ * clv_ * {d(A.MARGIN_RATE)} * ex_', 2)} AS value_saved,
         {rhu(f'CASE WHEN cost_ > 0 THEN red_ * clv_ * {d(A.MARGIN_RATE)} * ex_ / cost_ END', 2)} AS roi_ratio,
         {rhu(f'red_ * clv_ * {d(A.MARGIN_RATE)} * ex_ - cost_', 2)} AS net_benefit
       FROM av1 WHERE red_ > {d(A.MIN_REDUCTION)}),
avd AS (SELECT * EXCLUDE (dd) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {KEY}, base_feature,
          {rhu('predicted_churn_prob', 4)} ORDER BY driver_rank, scenario_order) AS dd FROM av) t WHERE dd = 1),
top AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {KEY} ORDER BY net_benefit DESC,
          predicted_churn_prob, feasibility_score DESC, driver_rank, scenario_order) AS action_rank FROM avd) t
        WHERE action_rank <= 3)"""


PIPE = f"{WS}, {BG_SQL}, {LOW_SQL}, {_prof_sql()}, {LEVELS_SQL}, {_drivers_sql()}"
VALUE_COLS = ("customer_id, base_feature, driver_rank, scenario_order, scenario_name, current_num, "
              "current_text, new_value_num, "
              "new_value_text, predicted_churn_prob, original_churn_prob, prob_reduction, "
              "feasibility_score, implementation_cost, customer_clv, value_saved, roi_ratio, net_benefit")


# ------------------------------------------------------------------ queries
@register("attribution_linear", f"{WS}, {BG_SQL}, {ATTR_SQL}\nSELECT * FROM attr")
def q_attribution_linear(spark, sf_dir):
    return linear_attribution(spark, sf_dir)


@register("attribution_rollup", f"""{WS}, {BG_SQL}, {ATTR_SQL},
ab AS (SELECT *, CASE feature {' '.join(f"WHEN '{f}' THEN '{b}'" for f, b in LINEAGE.items())} END AS base_feature FROM attr)
SELECT {KEY}, base_feature, SUM(contribution) AS contribution,
  (SELECT a2.value FROM ab a2 WHERE a2.{KEY} = ab.{KEY} AND a2.base_feature = ab.base_feature
   ORDER BY ABS(a2.contribution) DESC, a2.feature DESC LIMIT 1) AS value
FROM ab GROUP BY {KEY}, base_feature""")
def q_attribution_rollup(spark, sf_dir):
    return X.rollup(linear_attribution(spark, sf_dir), KEY, LINEAGE)


def _proxy_sql():
    parts = []
    for f, (v, _) in _terms_sql().items():
        parts.append(f"SELECT '{LINEAGE[f]}' AS base_feature, corr({v}, scored.score) AS r "
                     f"FROM scored, sc_stats")
    return (f"{WS}, r AS ({' UNION ALL '.join(parts)})\n"
            "SELECT base_feature, SUM(r) AS corr_sum FROM r WHERE r > 0 GROUP BY base_feature")


@register("driver_corr_proxy", _proxy_sql())
def q_driver_corr_proxy(spark, sf_dir):
    s, _, _, terms = _terms(spark, sf_dir)
    return X.correlation_proxy(s, "score", {f: v for f, (v, _) in terms.items()}, LINEAGE)


@register("actionable_signal", f"""{WS}, {BG_SQL}, {ATTR_SQL},
ab AS (SELECT {KEY}, CASE feature {' '.join(f"WHEN '{f}' THEN '{b}'" for f, b in LINEAGE.items())} END AS base_feature,
              contribution FROM attr),
rb AS (SELECT {KEY}, base_feature, SUM(contribution) AS contribution FROM ab GROUP BY 1, 2),
pos AS (SELECT * FROM rb WHERE contribution > 0 AND base_feature IN ({', '.join(f"'{b}'" for b in ACTIONABLE)}))
SELECT {KEY}, (SELECT p2.base_feature FROM pos p2 WHERE p2.{KEY} = pos.{KEY}
               ORDER BY p2.contribution DESC, p2.base_feature DESC LIMIT 1) AS top_feature,
       SUM(contribution) AS signal_sum, COUNT(*) AS n_drivers FROM pos GROUP BY {KEY}""")
def q_actionable_signal(spark, sf_dir):
    return signal_table(spark, sf_dir).drop("top_value")


def signal_table(spark, sf_dir, people=None):
    """Actionable signal of ``people`` (rows of the scored mart), or of everyone."""
    def build(attribution):
        return X.actionable_signal(X.rollup(attribution, KEY, LINEAGE), KEY, ACTIONABLE)
    if people is not None:
        return build(X.long_attribution(people, KEY, _terms(spark, sf_dir)[3]))
    return cached(spark, ("signal", sf_dir), lambda: build(linear_attribution(spark, sf_dir)))


def _permutation_sql():
    """The additive logit's permutation values by a running sum over (customer, order)."""
    terms = _terms_sql()
    table = X.permutation_table(len(terms))
    orders = ", ".join(f"({p}, {place}, {f})" for p, order in enumerate(table)
                       for place, f in enumerate(order))
    base = " + ".join([d(INTERCEPT)] + [f"{d(w)} * bg.z_{c}" for c, w in NUMERIC_WEIGHTS.items()]
                      + [f"{d(w)} * bg.i_{i}" for i, w in enumerate(DUMMY_WEIGHTS.values())])
    deltas = ", ".join(c for _, c in terms.values())
    names = ", ".join(f"'{f}'" for f in terms)
    return f"""{WS}, {BG_SQL},
orders(perm, place, f) AS (VALUES {orders}),
x AS (SELECT scored.{KEY}, [{deltas}] AS ds, {base} AS base FROM scored, sc_stats, bg),
steps AS (SELECT {KEY}, perm, place, f, base, ds[f + 1] AS delta,
                 SUM(ds[f + 1]) OVER (PARTITION BY {KEY}, perm ORDER BY place) AS upto FROM x, orders),
marginals AS (SELECT {KEY}, f, {d(1)} / ({d(1)} + EXP(-(base + upto)))
                              - {d(1)} / ({d(1)} + EXP(-(base + upto - delta))) AS m FROM steps)
SELECT {KEY}, ([{names}])[f + 1] AS feature, {rhu('AVG(m)', X.ATTRIBUTION_PLACES)} AS attribution
FROM marginals GROUP BY {KEY}, f"""


@register("attribution_permutation", _permutation_sql())
def q_attribution_permutation(spark, sf_dir):
    """Permutation Shapley values (probability scale), 8 orders for every customer (EX1)."""
    s, _, r, terms = _terms(spark, sf_dir)
    base = INTERCEPT + sum(w * r[f"z_{c}"] for c, w in NUMERIC_WEIGHTS.items()) + sum(
        w * r[f"i_{i}"] for i, w in enumerate(DUMMY_WEIGHTS.values()))
    return X.permutation_attribution(s, KEY, {f: c for f, (_, c) in terms.items()}, base)


@register("low_risk_profile", f"""{WS}, {LOW_SQL}, {_prof_sql()}
SELECT base_feature, kind, low_median, low_mode, overall_std, overall_min, overall_max,
       CAST(valid_count AS BIGINT) AS valid_count FROM prof""")
def q_low_risk_profile(spark, sf_dir):
    s, prof = _profile(spark, sf_dir)
    return A.profile_frame(spark, prof)


@register("driver_deviation", f"""{PIPE}
SELECT {KEY}, base_feature, contribution, deviation, CAST(driver_rank AS INTEGER) AS driver_rank FROM drv""")
def q_driver_deviation(spark, sf_dir):
    _, _, drv = driver_table(spark, sf_dir)
    return drv.select(KEY, "base_feature", "contribution", "deviation", "driver_rank")


@register("action_scenarios", f"""{PIPE}, {_scen_sql()}
SELECT {KEY}, base_feature, CAST(driver_rank AS INTEGER) AS driver_rank,
       CAST(scenario_order AS INTEGER) AS scenario_order, scenario_name, new_value_num, new_value_text FROM scen""")
def q_action_scenarios(spark, sf_dir):
    _, sc = scenario_table(spark, sf_dir)
    return sc.select(KEY, "base_feature", "driver_rank", "scenario_order", "scenario_name",
                     "new_value_num", "new_value_text")


ACTIONS_SQL = f"{PIPE}, {_scen_sql()}, {_values_sql()}"


def _cast_ranks(cols):
    return cols.replace("driver_rank, scenario_order",
                        "CAST(driver_rank AS INTEGER) AS driver_rank, "
                        "CAST(scenario_order AS INTEGER) AS scenario_order")


@register("action_values", f"{ACTIONS_SQL}\nSELECT {_cast_ranks(VALUE_COLS)} FROM av")
def q_action_values(spark, sf_dir):
    return value_table(spark, sf_dir)


@register("dedupe_actions", f"{ACTIONS_SQL}\nSELECT {_cast_ranks(VALUE_COLS)} FROM avd")
def q_dedupe_actions(spark, sf_dir):
    return A.dedupe_actions(value_table(spark, sf_dir), KEY)


@register("top_actions", f"""{ACTIONS_SQL}
SELECT {_cast_ranks(VALUE_COLS)}, CAST(action_rank AS INTEGER) AS action_rank FROM top""")
def q_top_actions(spark, sf_dir):
    return A.top_actions(A.dedupe_actions(value_table(spark, sf_dir), KEY), KEY)


@register("clv_estimate", f"""{WS},
g AS (SELECT LEAST({d(100000.0)}, GREATEST({d(100.0)}, quantile_cont(total_revenue, 0.5) * quantile_cont(CAST(tenure_days AS DOUBLE), 0.5))) AS clv_table FROM scored)
SELECT {KEY}, {_clv_sql()} AS clv_revenue_named,
  CASE WHEN total_revenue > 0 THEN total_revenue ELSE {d(A.DEFAULT_CLV)} END AS clv_monetary,
  clv_table FROM scored, g""")
def q_clv_estimate(spark, sf_dir):
    """Three CLV variants: revenue-named value x 24 (else 1,680); the customer's
    monetary value if positive (else 1,680); table median revenue x median
    tenure clamped to 100..100,000."""
    from ..functions.quantiles import quantiles_many
    s = build_scored(spark, sf_dir)
    qs = quantiles_many(s, {"r": F.col("total_revenue").cast("double"),
                            "t": F.col("tenure_days").cast("double")}, [0.5])
    table_clv = max(100.0, min(100000.0, qs["r"][0] * qs["t"][0]))
    return s.select(KEY, A.clv_expr(s).alias("clv_revenue_named"),
                    F.when(F.col("total_revenue") > 0, F.col("total_revenue"))
                    .otherwise(A.DEFAULT_CLV).alias("clv_monetary"),
                    F.lit(table_clv).alias("clv_table"))


@register("value_tier", f"""{WS},
v AS (SELECT {KEY}, score, ((({d(0.0)} + LEAST(total_revenue / {d(100.0)}, {d(10.0)}) * {d(0.4)})
        + LEAST(order_count / {d(2.0)}, {d(10.0)}) * {d(0.3)})
        + LEAST(account_balance / {d(3.0)}, {d(10.0)}) * {d(0.3)}) AS value_score FROM scored)
SELECT {KEY}, value_score,
  CASE WHEN value_score >= {d(6.5)} THEN 'High' WHEN value_score >= {d(3.5)} THEN 'Medium'
       WHEN value_score > 0 THEN 'Low' ELSE 'Unknown' END AS value_tier,
  CASE WHEN score >= {d(0.70)} THEN 'Critical' WHEN score >= {d(0.50)} THEN 'High' ELSE 'Moderate' END AS urgency,
  CASE WHEN (CASE WHEN value_score >= {d(6.5)} THEN 'High' WHEN value_score >= {d(3.5)} THEN 'Medium'
       WHEN value_score > 0 THEN 'Low' ELSE 'Unknown' END) IN ('High', 'Medium') AND score >= {d(0.50)}
       THEN 'High touch' ELSE 'Automated touchpoint' END AS investment
FROM v""")
def q_value_tier(spark, sf_dir):
    s = build_scored(spark, sf_dir)
    return A.value_tier(s, F.col("score")).select(KEY, "value_score", "value_tier", "urgency",
                                                  "investment")


ACTION_TEXT_SQL = (
    f"{ACTIONS_SQL}\nSELECT {KEY}, CAST(action_rank AS INTEGER) AS action_rank, "
    "CASE WHEN new_value_num IS NOT NULL THEN printf('Change %s from %.2f to %.2f', base_feature, "
    f"{rhu('current_num', 2)}, {rhu('new_value_num', 2)}) "
    "ELSE printf('Change %s from ''%s'' to ''%s''', base_feature, current_text, new_value_text) "
    "END AS description, printf('Reduces churn risk from %.1f%% to %.1f%%', "
    f"{rhu('original_churn_prob * 100', 1)}, {rhu('predicted_churn_prob * 100', 1)}) AS impact "
    "FROM top")


@register("action_text", ACTION_TEXT_SQL)
def q_action_text(spark, sf_dir):
    return A.action_text(A.top_actions(A.dedupe_actions(value_table(spark, sf_dir), KEY), KEY))
