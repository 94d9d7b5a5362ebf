"""Labels for an unlabelled customer table (the mart without its churn column)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labels as L
from ..operators.schema import detect_id_cols, numeric_columns
from .mart import MART_SQL, build_mart, cached
from .registry import register
from .sqlgen import d

KEY = "customer_id"


def unlabelled(spark, sf_dir):
    return build_mart(spark, sf_dir).drop("churn")


def heuristic(spark, sf_dir):
    def build():
        u = unlabelled(spark, sf_dir)
        return L.heuristic_risk(u, KEY, L.roles(u))
    return cached(spark, ("label_heuristic", sf_dir), build)


def _n(x, lo, hi):
    return f"({x} - {lo}) / ({hi} - {lo} + {d(1e-8)})"


HEUR_SQL = f"""WITH {MART_SQL},
u AS (SELECT * EXCLUDE (churn) FROM mart),
md AS (SELECT quantile_cont(CAST(tenure_days AS DOUBLE), 0.5) AS mt, quantile_cont(total_revenue, 0.5) AS mr,
              quantile_cont(usage_quantity, 0.5) AS mu, quantile_cont(complaint_ratio, 0.5) AS mc FROM u),
v AS (SELECT {KEY}, COALESCE(CAST(tenure_days AS DOUBLE), mt) AS t, COALESCE(total_revenue, mr) AS r,
             COALESCE(usage_quantity, mu) AS us, COALESCE(complaint_ratio, mc) AS c FROM u, md),
st AS (SELECT MIN(t) AS tl, MAX(t) AS th, MIN(r) AS rl, MAX(r) AS rh, MIN(us) AS ul, MAX(us) AS uh,
              MIN(c) AS cl, MAX(c) AS ch FROM v),
rr AS (SELECT {KEY}, (({d(0.0)} + ({d(1.0)} - {_n('t', 'tl', 'th')}) * {d(0.3)})
        + {_n('r', 'rl', 'rh')} * ({d(1.0)} - {_n('us', 'ul', 'uh')}) * {d(0.25)})
        + {_n('c', 'cl', 'ch')} * {d(0.15)} AS raw FROM v, st),
mx AS (SELECT MAX(raw) AS m FROM rr),
hs AS (SELECT {KEY}, CASE WHEN m > 0 THEN raw / m ELSE raw END AS risk_score FROM rr, mx),
th AS (SELECT quantile_cont(risk_score, 0.7) AS thr FROM hs),
lab AS (SELECT {KEY}, risk_score, CAST(risk_score >= thr AS INTEGER) AS label FROM hs, th)"""


@register("label_heuristic", f"{HEUR_SQL}\nSELECT * FROM lab")
def q_label_heuristic(spark, sf_dir):
    return heuristic(spark, sf_dir)


@register("label_confidence", f"""{HEUR_SQL},
ts AS (SELECT MIN(tenure_days) AS lo, MAX(tenure_days) AS hi FROM u),
x AS (SELECT lab.label, {d(0.0)} + ({d(1.0)} - {_n('CAST(u.tenure_days AS DOUBLE)', 'ts.lo', 'ts.hi')}) AS r
      FROM u JOIN lab USING ({KEY}), ts),
s AS (SELECT AVG(label) AS churn_rate, AVG(CASE WHEN label = 1 THEN r END) AS m1,
             AVG(CASE WHEN label = 0 THEN r END) AS m0 FROM x),
b AS (SELECT churn_rate, GREATEST({d(0.0)}, LEAST({d(1.0)}, ({d(1.0)} - ABS(churn_rate - {d(0.3)})) / {d(0.3)})) AS balance_score,
             COALESCE(LEAST({d(1.0)}, ABS(m1 - m0) * 2), {d(0.5)}) AS separation_score,
             {d(1.0)} AS indicator_coverage FROM s)
SELECT *, balance_score * {d(0.3)} + separation_score * {d(0.4)} + indicator_coverage * {d(0.3)} AS overall_confidence FROM b""")
def q_label_confidence(spark, sf_dir):
    u = unlabelled(spark, sf_dir)
    return L.confidence(u, KEY, heuristic(spark, sf_dir), L.roles(u))


@register("label_reliability", f"""WITH {MART_SQL},
n AS (SELECT COUNT(*) AS n FROM mart),
r AS (SELECT LEAST((40 + CASE WHEN n >= 1000 THEN 20 WHEN n >= 500 THEN 15 WHEN n >= 100 THEN 10 ELSE 5 END
                   + 20 + 15) / {d(100.0)}, {d(1.0)}) AS reliability FROM n)
SELECT 'heuristic' AS method, 7 AS n_indicators, 12 AS n_numeric, reliability,
  CASE WHEN reliability >= {d(0.75)} THEN 'HIGH' WHEN reliability >= {d(0.60)} THEN 'MODERATE'
       WHEN reliability >= {d(0.45)} THEN 'LOW' ELSE 'VERY LOW' END AS level,
  CASE WHEN reliability >= {d(0.75)} THEN '70-85%' WHEN reliability >= {d(0.60)} THEN '60-75%'
       WHEN reliability >= {d(0.45)} THEN '50-65%' ELSE '40-55%' END AS expected_accuracy FROM r""")
def q_label_reliability(spark, sf_dir):
    u = unlabelled(spark, sf_dir)
    rl = L.roles(u)
    method = L.choose_method(u, rl)
    lab = heuristic(spark, sf_dir)
    s = lab.agg({"label": "sum"}).first()[0]
    n = u.count()
    rel = L.reliability(n, len(numeric_columns(u)), rl)
    if s in (0, n):           # degenerate labels fall back to the forest, capped
        method, rel = "anomaly", min(rel, L.FALLBACK_RELIABILITY_CAP)
    level, expected = L.reliability_level(rel)
    return spark.createDataFrame(
        [(method, sum(len(v) for v in rl.values()), len(numeric_columns(u)), float(rel), level,
          expected)],
        "method string, n_indicators int, n_numeric int, reliability double, level string, "
        "expected_accuracy string")


def _model_cols(u):
    ids = detect_id_cols(u.columns)
    return [c for c in numeric_columns(u) if c not in ids]   # IDs excluded (deviation T20)


@register("label_auto", f"""{HEUR_SQL}, n AS (SELECT COUNT(*) AS n FROM mart)
SELECT {KEY}, label, 'heuristic' AS method,
  LEAST((40 + CASE WHEN n >= 1000 THEN 20 WHEN n >= 500 THEN 15 WHEN n >= 100 THEN 10 ELSE 5 END
         + 20 + 15) / {d(100.0)}, {d(1.0)}) AS reliability FROM lab, n""")
def q_label_auto(spark, sf_dir):
    """Labels by the method the table calls for, run end to end (UL4, UL7)."""
    u = unlabelled(spark, sf_dir)
    made, method, trust = L.auto_labels(u, KEY, _model_cols(u))
    return made.select(KEY, "label", F.lit(method).alias("method"), F.lit(trust).alias("reliability"))


@register("label_kmeans")
def q_label_kmeans(spark, sf_dir):
    u = unlabelled(spark, sf_dir)
    return L.kmeans_labels(u, KEY, _model_cols(u))


@register("label_isolation_forest")
def q_label_isolation_forest(spark, sf_dir):
    u = unlabelled(spark, sf_dir)
    return L.isolation_forest_labels(u, KEY, _model_cols(u))
