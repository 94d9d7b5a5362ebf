"""Costed retention actions for all customers in one pass (AC1-AC9, EX4,
TK4-TK6, JN5, JN6, WN8).

The reference builds actions one customer at a time, re-sampling and
re-scoring a reference set for each.  Here the reference (low-risk) profile is
computed once (a handful of scalars and short level lists), embedded as
literals, and every stage is a column expression over long tables keyed by
customer:

  scored -> drivers (customer x base feature, explode) -> top-3 drivers
  (window inside each customer, at most one row per feature) -> scenarios
  (explode of a computed array, at most 3 per driver) -> one rescoring
  expression -> value / cost / ROI -> de-duplicate -> top-3 actions.

Rows per customer are bounded by features x 3, so no group grows with data.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import q, round_half_up
from ..functions.ordering import global_row_number
from ..functions.quantiles import quantiles_many
from .explain import normalize_feature_key

# ---- fixed values (must equal the reference's) -------------------------------
INTERVENTION_COSTS = {
    "contract": 75, "onlinesecurity": 25, "techsupport": 25,
    "onlinebackup": 20, "deviceprotection": 20, "streamingtv": 15,
    "streamingmovies": 15, "paymentmethod": 10, "paperlessbilling": 5,
    "satisfactionscore": 40, "dayssincelastcontact": 15,
    "complaintproxy": 35, "internetservice": 50, "multiplelines": 20,
    "servicessubscribed": 30,
}
DEFAULT_COST = 25
FEASIBILITY_HIGH = {"contract", "paperlessbilling", "paymentmethod", "onlinesecurity",
                    "techsupport", "onlinebackup", "deviceprotection", "multiplelines",
                    "phoneservice"}
FEASIBILITY_MEDIUM = {"streamingtv", "streamingmovies", "internetservice", "servicessubscribed"}
EXECUTION_PROB = {"High": 0.85, "Medium": 0.70, "Low": 0.55}
MARGIN_RATE = 0.35
DEFAULT_CLV = 1680.0
CLV_REVENUE_KEYWORDS = ["monthly", "charge", "revenue", "value", "price", "amount", "fee"]
CLV_MIN_VALUE, CLV_MAX_VALUE, CLV_MONTHS = 10, 10000, 24
LOW_RISK_SHARE, LOW_RISK_MIN = 0.30, 30
DEVIATION_MIN = 0.15
MIN_VALID = 15
NUMERIC_SHARE_MIN = 0.8
MOVE_FRACTIONS = [(0.4, "Conservative"), (0.7, "Moderate"), (1.0, "Aggressive")]
FALLBACK_QUANTILES = [(0.35, "Conservative"), (0.5, "Moderate"), (0.65, "Aggressive")]
MIN_REDUCTION = 1e-6
TOP_DRIVERS = 3
TOP_ACTIONS = 3
VALUE_MONETARY_KEYWORDS = ["monetary", "revenue", "amount", "spending", "price", "sales",
                           "cashback", "ltv", "clv"]
VALUE_VOLUME_KEYWORDS = ["ordercount", "order_count", "frequency", "purchase", "transaction",
                         "visits"]
VALUE_LOYALTY_KEYWORDS = ["tenure", "age", "duration", "member", "subscription", "account"]
# ------------------------------------------------------------------------------

LEVELS_KEPT = 8        # first levels per column and population: three options are filled from them


def feasibility(base: str) -> tuple[int, str]:
    k = normalize_feature_key(base)
    if k in FEASIBILITY_HIGH:
        return 85, "High"
    if k in FEASIBILITY_MEDIUM:
        return 75, "Medium"
    return 65, "Medium"


def intervention_cost(base: str) -> float:
    return float(INTERVENTION_COSTS.get(normalize_feature_key(base), DEFAULT_COST))


def execution_probability(category: str) -> float:
    return float(min(1.0, max(0.1, EXECUTION_PROB.get(category, 0.70))))


def clv_expr(df: DataFrame) -> Column:
    """First revenue-named numeric column whose value lies in 10..10,000,
    times 24; else 1,680 (AC6, customer variant)."""
    cols = [f.name for f in df.schema.fields
            if any(k in f.name.lower() for k in CLV_REVENUE_KEYWORDS)
            and f.dataType.simpleString() in ("double", "int", "bigint", "float")]
    out = F.lit(None).cast("double")
    for c in reversed(cols):
        v = q(c).cast("double")
        out = F.when((v >= CLV_MIN_VALUE) & (v <= CLV_MAX_VALUE), v * F.lit(float(CLV_MONTHS))) \
            .otherwise(out)
    return F.coalesce(out, F.lit(DEFAULT_CLV))


@dataclass
class LowRiskProfile:
    """Reference (low-risk) statistics per base feature, computed once."""
    numeric: dict[str, dict] = field(default_factory=dict)
    categorical: dict[str, dict] = field(default_factory=dict)
    low_n: int = 0


def fit_low_risk_profile(scored: DataFrame, key: str, numeric: list[str],
                         categorical: list[str], score: str = "score") -> LowRiskProfile:
    """One ranked frame, then three fused passes: quantiles of every numeric
    column over all rows and over the low-risk rows (conditional columns in
    one aggregate), the scalar statistics, and the level counts of every
    categorical column for both populations (one grouped pass)."""
    n = scored.count()
    low_n = min(n, max(LOW_RISK_MIN, int(n * LOW_RISK_SHARE)))
    ranked = global_row_number(scored, [score, key], "_risk_rank")
    is_low = F.col("_risk_rank") <= F.lit(low_n)
    prof = LowRiskProfile(low_n=low_n)
    exprs = {c: q(c).cast("double") for c in numeric}
    exprs.update({f"__low__{c}": F.when(is_low, q(c).cast("double")) for c in numeric})
    qs = quantiles_many(ranked, exprs, [0.35, 0.5, 0.65])
    st = scored.agg(*[F.stddev_samp(c).alias(f"sd_{c}") for c in numeric],
                    *[F.min(c).alias(f"lo_{c}") for c in numeric],
                    *[F.max(c).alias(f"hi_{c}") for c in numeric],
                    *[F.count(c).alias(f"n_{c}") for c in numeric],
                    *[F.avg(q(c).isNotNull().cast("double")).alias(f"sh_{c}") for c in numeric],
                    *[F.bool_and(q(c).isNull() | q(c).isin(0, 1)).alias(f"bin_{c}")
                      for c in numeric]).first()
    for c in numeric:
        if not st[f"n_{c}"]:
            continue                   # no valid value: nothing to compare with
        low_med = qs[f"__low__{c}"][1]
        sd = st[f"sd_{c}"]
        prof.numeric[c] = {
            "low_median": low_med if low_med is not None else qs[c][1], "std": sd,
            "scale": sd if sd is not None and sd > 1e-9 else 1.0,
            "min": float(st[f"lo_{c}"]), "max": float(st[f"hi_{c}"]),
            "valid": int(st[f"n_{c}"]), "share": float(st[f"sh_{c}"]),
            "binary": bool(st[f"bin_{c}"]), "q35": qs[c][0], "q50": qs[c][1],
            "q65": qs[c][2]}
    if categorical:
        counts = level_counts(ranked, categorical, is_low)
        for c in categorical:
            rows = counts.get(c, [])
            al = [v for v, _, _ in sorted(rows, key=lambda t: (-t[1], t[0]))]
            lo = [v for v, _, lw in sorted(rows, key=lambda t: (-t[2], t[0])) if lw > 0]
            prof.categorical[c] = {"low_order": lo, "global_order": al,
                                   "low_mode": lo[0] if lo else None}
    return prof


def level_counts(df: DataFrame, cols: list[str], flag: Column) -> dict[str, list]:
    """(level, rows, flagged rows) per column in one grouped pass: the first
    ``LEVELS_KEPT`` levels by rows and by flagged rows, however many there are."""
    longf = df.select(flag.alias("_f"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"),
                 F.coalesce(q(c).cast("string"), F.lit("None")).alias("level"))
        for c in cols])).alias("kv")).select("kv.*", "_f")
    g = longf.groupBy("column_name", "level").agg(F.count(F.lit(1)).alias("n"),
                                                  F.count_if("_f").alias("n_flag"))
    # a first cut inside 64 parts of each column keeps the window's groups small
    part = F.pmod(F.xxhash64("level"), F.lit(64))
    by_n, by_flag = (F.col(c).desc() for c in ("n", "n_flag"))
    for keys in ([F.col("column_name"), part], [F.col("column_name")]):
        g = g.withColumn("_a", F.row_number().over(Window.partitionBy(*keys).orderBy(by_n, "level"))) \
            .withColumn("_b", F.row_number().over(Window.partitionBy(*keys).orderBy(by_flag, "level"))) \
            .where((F.col("_a") <= LEVELS_KEPT) | (F.col("_b") <= LEVELS_KEPT)).drop("_a", "_b")
    out: dict[str, list] = {}
    for r in g.collect():
        out.setdefault(r["column_name"], []).append((r["level"], r["n"], r["n_flag"]))
    return out


def profile_frame(spark, prof: LowRiskProfile) -> DataFrame:
    rows = [(c, "numeric", p["low_median"], None, p["std"], p["min"], p["max"], p["valid"])
            for c, p in prof.numeric.items()]
    rows += [(c, "categorical", None, p["low_mode"], None, None, None, None)
             for c, p in prof.categorical.items()]
    return spark.createDataFrame(rows, "base_feature string, kind string, low_median double, "
                                       "low_mode string, overall_std double, overall_min double, "
                                       "overall_max double, valid_count long")


def drivers(scored: DataFrame, key: str, contributions: dict[str, Column],
            prof: LowRiskProfile, actionable: list[str]) -> DataFrame:
    """Positive, actionable drivers with their deviation from the low-risk
    profile; personalised (> 0.15) when at least two are, top 3 by |c| (EX4)."""
    items = []
    for b, c in contributions.items():
        if b not in actionable:
            continue
        if b in prof.numeric:
            p = prof.numeric[b]
            x = q(b).cast("double")
            numeric_ok = x.isNotNull() & F.lit(p["share"] >= NUMERIC_SHARE_MIN)
            dev = F.when(numeric_ok, F.abs(x - F.lit(p["low_median"])) / F.lit(p["scale"])) \
                .otherwise(F.lit(1.0))
            items.append(F.struct(F.lit(b).alias("base_feature"), c.alias("contribution"),
                                  x.alias("current_num"),
                                  F.lit(None).cast("string").alias("current_text"),
                                  dev.alias("deviation")))
        elif b in prof.categorical:
            p = prof.categorical[b]
            t = F.coalesce(q(b).cast("string"), F.lit("None"))
            dev = F.when(t != F.lit(p["low_mode"]), 1.0).otherwise(0.0)
            items.append(F.struct(F.lit(b).alias("base_feature"), c.alias("contribution"),
                                  F.lit(None).cast("double").alias("current_num"),
                                  t.alias("current_text"), dev.alias("deviation")))
    x = scored.select(F.col(key), F.explode(F.array(*items)).alias("d")).select(key, "d.*")
    x = x.where(F.col("contribution") > 0)
    w_all = Window.partitionBy(key)
    x = x.withColumn("_n_personal", F.count_if(F.col("deviation") > DEVIATION_MIN).over(w_all))
    x = x.where((F.col("_n_personal") < 2) | (F.col("deviation") > DEVIATION_MIN))
    w = Window.partitionBy(key).orderBy(F.abs("contribution").desc(), "base_feature")
    return (x.withColumn("driver_rank", F.row_number().over(w))
            .where(F.col("driver_rank") <= TOP_DRIVERS).drop("_n_personal"))


def scenarios(drv: DataFrame, key: str, prof: LowRiskProfile) -> DataFrame:
    """Candidate values per driver (AC2), exploded with their order."""
    cur = F.col("current_num")
    num_branches, cat_branches = [], []
    for b, p in prof.numeric.items():
        if p["valid"] < MIN_VALID:
            arr = F.array().cast("array<struct<name:string,num:double,text:string>>")
        elif p["binary"]:
            flip = F.when(cur >= 0.5, 0.0).otherwise(1.0)
            arr = F.array(F.struct(F.lit("Toggle").alias("name"), flip.alias("num"),
                                   F.lit(None).cast("string").alias("text")))
        else:
            gap = F.lit(p["low_median"]) - cur
            moves = F.array(*[F.struct(F.lit(n).alias("name"),
                                       F.least(F.greatest(cur + F.lit(f) * gap, F.lit(p["min"])),
                                               F.lit(p["max"])).alias("num"),
                                       F.lit(None).cast("string").alias("text"))
                              for f, n in MOVE_FRACTIONS])
            qv = {0.35: p["q35"], 0.5: p["q50"], 0.65: p["q65"]}
            quant = F.filter(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(qv[f]).cast("double")
                                                .alias("num"),
                                                F.lit(None).cast("string").alias("text"))
                                       for f, n in FALLBACK_QUANTILES]),
                             lambda s: F.abs(s["num"] - cur) > F.lit(1e-9))
            arr = F.when(F.abs(gap) > F.lit(1e-9), moves).otherwise(quant)
        num_branches.append((b, arr))
    for b, p in prof.categorical.items():
        t = F.col("current_text")
        low = F.filter(F.array(*[F.lit(v) for v in p["low_order"]]), lambda v: v != t)
        ext = F.filter(F.array(*[F.lit(v) for v in p["global_order"]]),
                       lambda v: (v != t) & ~F.array_contains(low, v))
        cands = F.slice(F.when(F.size(low) < 2, F.concat(low, ext)).otherwise(low), 1, 3)
        arr = F.transform(cands, lambda v, i: F.struct(
            F.concat(F.lit("Option"), (i + 1).cast("string")).alias("name"),
            F.lit(None).cast("double").alias("num"), v.alias("text")))
        cat_branches.append((b, arr))
    expr = None
    for b, arr in num_branches + cat_branches:
        expr = (F.when(F.col("base_feature") == b, arr) if expr is None
                else expr.when(F.col("base_feature") == b, arr))
    x = drv.select("*", F.posexplode(expr).alias("scenario_order", "s"))
    x = x.select(*drv.columns, (F.col("scenario_order") + 1).alias("scenario_order"),
                 F.col("s.name").alias("scenario_name"), F.col("s.num").alias("new_value_num"),
                 F.col("s.text").alias("new_value_text"))
    # numeric moves that round to the same 6-decimal value keep the first
    w = Window.partitionBy(key, "base_feature", round_half_up(F.col("new_value_num"), 6)) \
        .orderBy("scenario_order")
    x = x.withColumn("_dup", F.when(F.col("new_value_num").isNotNull(), F.row_number().over(w))
                     .otherwise(F.lit(1)))
    return x.where(F.col("_dup") == 1).drop("_dup")


def action_values(sc: DataFrame, scored: DataFrame, key: str,
                  prob_fn: Callable[[dict[str, Column]], Column], inputs: list[str],
                  numeric: list[str], score: str = "score") -> DataFrame:
    """Rescore every scenario once and price it (AC3, AC4, JN5)."""
    feas = {b: feasibility(b) for b in inputs}
    cost = F.create_map(*[x for b in inputs for x in (F.lit(b), F.lit(intervention_cost(b)))])
    fscore = F.create_map(*[x for b in inputs for x in (F.lit(b), F.lit(feas[b][0]))])
    fexec = F.create_map(*[x for b in inputs
                           for x in (F.lit(b), F.lit(execution_probability(feas[b][1])))])
    cust = scored.select(key, score, *[c for c in inputs], clv_expr(scored).alias("customer_clv"))
    x = sc.join(cust, key)
    vals = {}
    for c in inputs:
        new = F.col("new_value_num") if c in numeric else F.col("new_value_text")
        vals[c] = F.when(F.col("base_feature") == c, new).otherwise(F.col(c))
    new_prob = F.least(F.greatest(prob_fn(vals), F.lit(0.0)), F.lit(1.0))
    orig = F.least(F.greatest(F.col(score), F.lit(0.0)), F.lit(1.0))
    x = x.withColumn("_new", new_prob).withColumn("_orig", orig)
    x = x.withColumn("_red", F.greatest(F.lit(0.0), F.col("_orig") - F.col("_new")))
    x = x.where(F.col("_red") > MIN_REDUCTION)
    saved = (F.col("_red") * F.col("customer_clv") * F.lit(MARGIN_RATE)
             * fexec[F.col("base_feature")])
    c_ = cost[F.col("base_feature")]
    return x.select(
        key, "base_feature", "driver_rank", "scenario_order", "scenario_name", "current_num",
        "current_text", "new_value_num",
        "new_value_text", round_half_up(F.col("_new"), 6).alias("predicted_churn_prob"),
        round_half_up(F.col("_orig"), 6).alias("original_churn_prob"),
        round_half_up(F.col("_red"), 6).alias("prob_reduction"),
        fscore[F.col("base_feature")].alias("feasibility_score"),
        round_half_up(c_, 2).alias("implementation_cost"),
        round_half_up(F.col("customer_clv"), 2).alias("customer_clv"),
        round_half_up(saved, 2).alias("value_saved"),
        round_half_up(F.when(c_ > 0, saved / c_), 2).alias("roi_ratio"),
        round_half_up(saved - c_, 2).alias("net_benefit"))


def dedupe_actions(av: DataFrame, key: str) -> DataFrame:
    """First action per (feature, probability rounded to 4) in generation order (WN8)."""
    w = Window.partitionBy(key, "base_feature", round_half_up(F.col("predicted_churn_prob"), 4)) \
        .orderBy("driver_rank", "scenario_order")
    return av.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def top_actions(av: DataFrame, key: str, n: int = TOP_ACTIONS) -> DataFrame:
    """Net benefit desc, probability asc, feasibility desc; first n (TK6)."""
    w = Window.partitionBy(key).orderBy(F.col("net_benefit").desc(), "predicted_churn_prob",
                                        F.col("feasibility_score").desc(), "driver_rank",
                                        "scenario_order")
    return av.withColumn("action_rank", F.row_number().over(w)).where(F.col("action_rank") <= n)


def value_tier(df: DataFrame, prob: Column) -> DataFrame:
    """Customer value score 0..10 from the first monetary, volume and loyalty
    columns, tier, urgency and investment level (AC7, rule part)."""
    def first(keys, strip=False):
        for f in df.schema.fields:
            name = f.name.lower().replace("_", "") if strip else f.name.lower()
            if any(k in name for k in keys) and f.dataType.simpleString() in (
                    "double", "int", "bigint", "float"):
                return f.name
        return None
    m, v, l_ = (first(VALUE_MONETARY_KEYWORDS), first(VALUE_VOLUME_KEYWORDS, True),
                first(VALUE_LOYALTY_KEYWORDS))
    score = F.lit(0.0)
    for c, div, wt in ((m, 100.0, 0.4), (v, 2.0, 0.3), (l_, 3.0, 0.3)):
        if c:
            score = score + F.least(q(c).cast("double") / F.lit(div), F.lit(10.0)) * F.lit(wt)
    tier = (F.when(score >= 6.5, "High").when(score >= 3.5, "Medium").when(score > 0, "Low")
            .otherwise("Unknown"))
    urgency = (F.when(prob >= 0.70, "Critical").when(prob >= 0.50, "High").otherwise("Moderate"))
    invest = F.when(tier.isin("High", "Medium") & (prob >= 0.50), "High touch") \
        .otherwise("Automated touchpoint")
    return df.select("*", score.alias("value_score"), tier.alias("value_tier"),
                     urgency.alias("urgency"), invest.alias("investment"))


def action_text(top: DataFrame) -> DataFrame:
    """Rule text of an action and its impact line (AC8)."""
    num = F.col("new_value_num").isNotNull()
    desc = F.when(num, F.format_string("Change %s from %.2f to %.2f", F.col("base_feature"),
                                       round_half_up(F.col("current_num"), 2),
                                       round_half_up(F.col("new_value_num"), 2))) \
        .otherwise(F.format_string("Change %s from '%s' to '%s'", F.col("base_feature"),
                                   F.col("current_text"), F.col("new_value_text")))
    impact = F.format_string("Reduces churn risk from %.1f%% to %.1f%%",
                             round_half_up(F.col("original_churn_prob") * 100, 1),
                             round_half_up(F.col("predicted_churn_prob") * 100, 1))
    return top.select(top.columns[0], "action_rank", desc.alias("description"),
                      impact.alias("impact"))
