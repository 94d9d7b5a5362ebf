"""Scoring board, KPIs and evaluation metrics on the fixed-scorecard table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features, metrics as M
from .registry import register
from .scored import SCORED_SQL, build_scored
from .sqlgen import d

WS = f"WITH {SCORED_SQL}"
THR = M.DEFAULT_THRESHOLD
SPLIT_SCORED_SQL = f"""sp AS (SELECT *, CASE WHEN ROW_NUMBER() OVER (PARTITION BY churn ORDER BY h, customer_id)
                      <= n_c - (n_c * 25 + 99) // 100 THEN 'train' ELSE 'test' END AS split
       FROM (SELECT *, {features.sql_split_hash('customer_id')} AS h,
                    COUNT(*) OVER (PARTITION BY churn) AS n_c FROM scored) t)"""


def scored_split(spark, sf_dir):
    return features.stratified_split(build_scored(spark, sf_dir), "customer_id", "churn")


def _clip_sql(x):
    return f"LEAST(GREATEST({x}, {d(M.CLIP_LO)}), {d(M.CLIP_HI)})"


@register("score_board", f"""{WS}
SELECT customer_id, churn, score, {_clip_sql('score')} AS probability,
  CASE WHEN score > {d(THR)} THEN 'Churn' ELSE 'Stay' END AS prediction,
  CASE WHEN ABS({_clip_sql('score')} - {d(THR)}) > {d(0.25)} THEN 'High'
       WHEN ABS({_clip_sql('score')} - {d(THR)}) > {d(0.10)} THEN 'Medium' ELSE 'Low' END AS confidence
FROM scored""")
def q_score_board(spark, sf_dir):
    s = build_scored(spark, sf_dir)
    p = M.clip_probability(F.col("score"))
    return s.select("customer_id", "churn", "score", p.alias("probability"),
                    F.when(F.col("score") > THR, "Churn").otherwise("Stay").alias("prediction"),
                    M.confidence(p, THR).alias("confidence"))


@register("kpi_row", f"""{WS}
SELECT COUNT(*) AS n_customers, AVG(CAST(churn AS DOUBLE)) AS churn_rate,
  AVG(CAST(score > {d(THR)} AS DOUBLE)) AS predicted_churn_share,
  COUNT(*) FILTER (WHERE score > {d(THR)}) AS at_risk_count FROM scored""")
def q_kpi_row(spark, sf_dir):
    s = build_scored(spark, sf_dir)
    return s.agg(F.count(F.lit(1)).alias("n_customers"),
                 F.avg(F.col("churn").cast("double")).alias("churn_rate"),
                 F.avg((F.col("score") > THR).cast("double")).alias("predicted_churn_share"),
                 F.count_if(F.col("score") > THR).alias("at_risk_count"))


@register("at_risk_filter", f"""{WS},
t AS (SELECT CASE WHEN COUNT(*) FILTER (WHERE score > {d(THR)}) < 20 THEN {d(M.FALLBACK_THRESHOLD)}
                  ELSE {d(THR)} END AS thr FROM scored)
SELECT customer_id, score, thr AS threshold_used FROM scored, t WHERE score > thr""")
def q_at_risk_filter(spark, sf_dir):
    s = build_scored(spark, sf_dir)
    n = s.where(F.col("score") > THR).count()
    thr = THR if n >= M.MIN_AT_RISK else M.FALLBACK_THRESHOLD
    return s.where(F.col("score") > thr).select("customer_id", "score",
                                                 F.lit(thr).alias("threshold_used"))


def _rates_sql(src, cond):
    return f"""SELECT tp, fp, tn, fn,
  (tp + tn) / CAST(tp + fp + tn + fn AS DOUBLE) AS accuracy,
  CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0.0 END AS precision,
  CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0.0 END AS recall,
  CASE WHEN tp > 0 OR fp > 0 OR fn > 0 THEN
    CASE WHEN tp = 0 THEN 0.0 ELSE 2 * CAST(tp AS DOUBLE) / (2 * tp + fp + fn) END ELSE 0.0 END AS f1,
  CASE WHEN tn + fp > 0 THEN tn / CAST(tn + fp AS DOUBLE) ELSE 0.0 END AS specificity
FROM (SELECT COUNT(*) FILTER (WHERE {cond} AND churn = 1) AS tp,
             COUNT(*) FILTER (WHERE {cond} AND churn <> 1) AS fp,
             COUNT(*) FILTER (WHERE NOT ({cond}) AND churn <> 1) AS tn,
             COUNT(*) FILTER (WHERE NOT ({cond}) AND churn = 1) AS fn FROM {src}) c"""


@register("confusion_metrics", f"""{WS}
SELECT *, {d(THR)} AS threshold FROM ({_rates_sql('scored', f'score >= {d(THR)}')}) r""")
def q_confusion_metrics(spark, sf_dir):
    s = build_scored(spark, sf_dir)
    return M.confusion(s, "churn", "score", THR, strict=False).withColumn(
        "threshold", F.lit(THR))


AUC_SQL = """SELECT SUM(pos * (cneg - neg + {half} * neg)) / (CAST(SUM(pos) AS DOUBLE) * CAST(SUM(neg) AS DOUBLE)) AS auc,
  CAST(SUM(pos) AS BIGINT) AS positives, CAST(SUM(neg) AS BIGINT) AS negatives
FROM (SELECT *, SUM(neg) OVER (ORDER BY s ROWS UNBOUNDED PRECEDING) AS cneg FROM
  (SELECT score AS s, COUNT(*) FILTER (WHERE churn = 1) AS pos, COUNT(*) FILTER (WHERE churn <> 1) AS neg
   FROM {src} GROUP BY score) g) c"""


@register("auc_rank", f"{WS}\n" + AUC_SQL.format(half=d(0.5), src="scored"))
def q_auc_rank(spark, sf_dir):
    s = build_scored(spark, sf_dir)
    a = M.auc(s, "churn", "score")
    tot = s.agg(F.count_if(F.col("churn") == 1).alias("p"), F.count_if(F.col("churn") != 1)
                .alias("n")).first()
    return spark.createDataFrame([(a, int(tot["p"]), int(tot["n"]))],
                                 "auc double, positives long, negatives long")


@register("youden_threshold", f"""{WS}, {SPLIT_SCORED_SQL},
te AS (SELECT * FROM sp WHERE split = 'test'),
tot AS (SELECT CAST(COUNT(*) FILTER (WHERE churn = 1) AS DOUBLE) AS P,
               CAST(COUNT(*) FILTER (WHERE churn <> 1) AS DOUBLE) AS N FROM te),
g AS (SELECT score AS s, COUNT(*) FILTER (WHERE churn = 1) AS pos,
             COUNT(*) FILTER (WHERE churn <> 1) AS neg FROM te GROUP BY score),
c AS (SELECT s, SUM(pos) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) / P
              - SUM(neg) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) / N AS j FROM g, tot),
b AS (SELECT s, j FROM c ORDER BY j DESC, s DESC LIMIT 1),
r AS (SELECT CASE WHEN j > 0 THEN s ELSE CAST('inf' AS DOUBLE) END AS raw_threshold,
             CASE WHEN j > 0 THEN j ELSE {d(0.0)} END AS best_j FROM b)
SELECT raw_threshold, best_j, GREATEST({d(0.1)}, LEAST({d(0.9)}, raw_threshold)) AS threshold FROM r""")
def q_youden_threshold(spark, sf_dir):
    te = scored_split(spark, sf_dir).where(F.col("split") == "test")
    y = M.youden(te, "churn", "score")
    return spark.createDataFrame([(y["raw_threshold"], y["best_j"], float(y["threshold"]))],
                                 "raw_threshold double, best_j double, threshold double")


def _bins_sql(n_bins):
    edges = M.calibration_edges(n_bins)[1:-1]
    return "(" + " + ".join(f"CAST(score > {d(e)} AS INTEGER)" for e in edges) + ")"


@register("calibration_table", f"""{WS}
SELECT {_bins_sql(10)} AS bin, AVG(score) AS mean_predicted,
  AVG(CAST(churn AS DOUBLE)) AS fraction_positive, COUNT(*) AS count
FROM scored GROUP BY 1""")
def q_calibration_table(spark, sf_dir):
    return M.calibration_bins(build_scored(spark, sf_dir), "churn", "score", 10)


def _brier_sql():
    cases = []
    for nb in range(2, 11):
        cases.append(f"WHEN {nb} THEN {_bins_sql(nb)}")
    return f"""{WS},
nb AS (SELECT LEAST(10, GREATEST(2, CAST(FLOOR(COUNT(*) / 20) AS INTEGER))) AS n_bins,
              AVG((LEAST(GREATEST(score, {d(0.0)}), {d(1.0)}) - churn) * (LEAST(GREATEST(score, {d(0.0)}), {d(1.0)}) - churn)) AS brier
       FROM scored),
b AS (SELECT CASE n_bins {' '.join(cases)} END AS bin, score, churn FROM scored, nb),
g AS (SELECT bin, ABS(AVG(score) - AVG(CAST(churn AS DOUBLE))) AS gap FROM b GROUP BY bin)
SELECT brier, n_bins, (SELECT AVG(gap) FROM g) AS calibration_mae FROM nb"""


@register("brier_calibration", _brier_sql())
def q_brier_calibration(spark, sf_dir):
    s = build_scored(spark, sf_dir)
    p = F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0))
    r = s.agg(F.count(F.lit(1)).alias("n"),
              F.avg((p - F.col("churn")) * (p - F.col("churn"))).alias("brier")).first()
    nb = min(10, max(2, int(r["n"] / 20)))
    bins = M.calibration_bins(s, "churn", "score", nb)
    mae = bins.agg(F.avg(F.abs(F.col("mean_predicted") - F.col("fraction_positive")))).first()[0]
    return spark.createDataFrame([(float(r["brier"]), nb, float(mae))],
                                 "brier double, n_bins int, calibration_mae double")


def _cut_sql(fracs, label):
    vals = ", ".join(f"({i + 1}, {d(f)})" for i, f in enumerate(fracs))
    return f"""r AS (SELECT ROW_NUMBER() OVER (ORDER BY score DESC, customer_id) AS k,
               SUM(churn) OVER (ORDER BY score DESC, customer_id ROWS UNBOUNDED PRECEDING) AS captured
        FROM scored),
steps AS (SELECT * FROM (VALUES {vals}) t({label}_index, f)),
nn AS (SELECT COUNT(*) AS n, SUM(churn) AS P FROM scored),
cut AS (SELECT {label}_index, f, GREATEST(1, CAST(FLOOR(f * n) AS BIGINT)) AS k, P FROM steps, nn)"""


@register("gains_curve", f"""{WS}, {_cut_sql(M.gain_steps(), 'step')}
SELECT step_index AS pct, cut.k, CAST(captured AS BIGINT) AS captured, CAST(P AS BIGINT) AS positives,
       captured / CAST(P AS DOUBLE) AS gain
FROM cut JOIN r ON r.k = cut.k""")
def q_gains_curve(spark, sf_dir):
    s = build_scored(spark, sf_dir)
    t = M.cut_table(s, "churn", "score", "customer_id", M.gain_steps(), "step")
    return t.select(F.col("step_index").alias("pct"), "k", "captured", "positives",
                    (F.col("captured") / F.col("positives")).alias("gain"))


@register("lift_table", f"""{WS}, {_cut_sql(M.LIFT_TIERS, 'tier')}
SELECT CAST(ROUND(f * 100) AS INTEGER) AS tier_pct, cut.k, CAST(captured AS BIGINT) AS captured,
       CAST(P AS BIGINT) AS positives, captured / CAST(P AS DOUBLE) AS recall,
       captured / CAST(P AS DOUBLE) / f AS lift
FROM cut JOIN r ON r.k = cut.k""")
def q_lift_table(spark, sf_dir):
    s = build_scored(spark, sf_dir)
    t = M.cut_table(s, "churn", "score", "customer_id", M.LIFT_TIERS, "tier")
    rec = F.col("captured") / F.col("positives")
    return t.select(F.round(F.col("tier") * 100).cast("int").alias("tier_pct"), "k", "captured",
                    "positives", rec.alias("recall"), (rec / F.col("tier")).alias("lift"))


def _verdict_sql():
    per = []
    for sp in ("train", "test"):
        per.append(f"{sp}_m AS (SELECT * FROM ({_rates_sql(f'(SELECT * FROM sp WHERE split = {chr(39)}{sp}{chr(39)})', f'score > {d(THR)}')}) x, "
                   f"({AUC_SQL.format(half=d(0.5), src=f'(SELECT * FROM sp WHERE split = {chr(39)}{sp}{chr(39)})')}) a)")
    return f"""{WS}, {SPLIT_SCORED_SQL}, {', '.join(per)},
meta AS (SELECT COUNT(*) AS n_test, AVG(CAST(churn AS DOUBLE)) AS rate FROM sp WHERE split = 'test'),
v AS (SELECT tr.auc AS train_auc, te.auc AS test_auc, tr.f1 AS train_f1, te.f1 AS test_f1,
             tr.accuracy AS train_accuracy, te.accuracy AS test_accuracy,
             tr.auc - te.auc AS auc_gap, tr.f1 - te.f1 AS f1_gap, tr.accuracy - te.accuracy AS accuracy_gap,
             te.precision AS test_precision, te.recall AS test_recall,
             {d(1.5)} / SQRT(GREATEST(n_test, 1)) + {d(0.0)} + GREATEST({d(0.0)}, ({d(0.1)} - LEAST(rate, 1 - rate)) * {d(0.5)}) AS expected_gap
      FROM train_m tr, test_m te, meta),
f AS (SELECT *, LEAST({d(0.30)}, {d(3.5)} * expected_gap) AS severe, LEAST({d(0.20)}, {d(2.0)} * expected_gap) AS moderate FROM v),
k AS (SELECT *,
   (CASE WHEN test_auc > {d(0.97)} OR train_auc > {d(0.97)} THEN 2 ELSE 0 END)
 + (CASE WHEN auc_gap > severe OR f1_gap > severe THEN 1 ELSE 0 END)
 + (CASE WHEN test_auc < {d(0.52)} THEN 1 ELSE 0 END)
 + (CASE WHEN test_f1 < {d(0.20)} THEN 1 ELSE 0 END) AS n_issues,
   (CASE WHEN NOT (auc_gap > severe OR f1_gap > severe) AND (auc_gap > moderate OR f1_gap > moderate) THEN 1 ELSE 0 END)
 + (CASE WHEN test_auc >= {d(0.52)} AND test_auc < {d(0.58)} THEN 1 ELSE 0 END)
 + (CASE WHEN test_f1 >= {d(0.20)} AND test_f1 < {d(0.35)} THEN 1 ELSE 0 END) AS n_warnings FROM f)
SELECT train_auc, test_auc, train_f1, test_f1, train_accuracy, test_accuracy, auc_gap, f1_gap,
  accuracy_gap, expected_gap, severe AS severe_threshold, moderate AS moderate_threshold,
  n_issues, n_warnings,
  CASE WHEN n_issues > 0 THEN 'CRITICAL' WHEN n_warnings > 0 THEN 'WARNING' ELSE 'HEALTHY' END AS status,
  CASE WHEN auc_gap < {d(0.05)} THEN 'Low' WHEN auc_gap < {d(0.10)} THEN 'Moderate' ELSE 'High' END AS generalisation,
  (test_accuracy >= {d(0.995)} AND test_precision >= {d(0.995)} AND test_recall >= {d(0.995)}
   AND test_f1 >= {d(0.995)} AND test_auc >= {d(0.995)}) AS near_perfect
FROM k"""


@register("train_test_verdict", _verdict_sql())
def q_train_test_verdict(spark, sf_dir):
    res = {r["split"]: r.asDict() for r in M.split_metrics(
        scored_split(spark, sf_dir), "split", "churn", "score", THR).collect()}
    v = M.verdict(res["train"], res["test"], int(res["test"]["n"]), float(res["test"]["rate"]))
    tr, te = res["train"], res["test"]
    row = (tr["auc"], te["auc"], tr["f1"], te["f1"], tr["accuracy"], te["accuracy"],
           v["gaps"]["auc"], v["gaps"]["f1"], v["gaps"]["accuracy"], v["expected_gap"],
           v["severe"], v["moderate"], len(v["issues"]), len(v["warnings"]), v["status"],
           v["generalisation"], v["near_perfect"])
    return spark.createDataFrame([row], (
        "train_auc double, test_auc double, train_f1 double, test_f1 double, "
        "train_accuracy double, test_accuracy double, auc_gap double, f1_gap double, "
        "accuracy_gap double, expected_gap double, severe_threshold double, "
        "moderate_threshold double, n_issues int, n_warnings int, status string, "
        "generalisation string, near_perfect boolean"))
