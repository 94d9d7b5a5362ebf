"""Training queries (rows-only checks: learners are MLlib's, not the reference's)."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from ..operators import features
from ..operators import models as MD
from ..sources.derived import DERIVED
from .mart import MART_SQL, MART_TABLES, build_mart
from .registry import register
from .scored import SCORED_SQL, build_scored
from .sqlgen import d

KEY = "customer_id"
LABEL = "churn"
NUMERIC = ["account_balance", "tenure_days", "days_since_last_order", "order_count",
           "total_revenue", "avg_order_value", "monthly_charges", "usage_quantity",
           "complaint_ratio", "avg_discount", "urgent_share"]
CATEGORICAL = ["segment", "main_priority"]


def training(spark, sf_dir):
    """Split, weights, folds, learner comparison; trained once for the same files."""
    return DERIVED.get(spark, sf_dir, ("training",), MART_TABLES, lambda: _train(spark, sf_dir),
                       lambda state: state["train"].unpersist())


def _train(spark, sf_dir):
    m = build_mart(spark, sf_dir)
    sp = features.stratified_split(m, KEY, LABEL).persist(StorageLevel.MEMORY_AND_DISK)
    st = m.agg(F.sum(LABEL).alias("p"), F.count(F.lit(1)).alias("n")).first()
    folds = features.adaptive_folds(int(st["p"]), int(st["n"]))
    train = MD.add_folds(MD.class_weights(sp.where(F.col("split") == "train"), LABEL), KEY, folds)
    train = train.withColumn(LABEL, F.col(LABEL).cast("double"))
    test = MD.laid_out(sp.where(F.col("split") == "test").withColumn(
        LABEL, F.col(LABEL).cast("double")), KEY)
    prep, train, (test, everyone) = MD.prepare(train, [test, m], NUMERIC, CATEGORICAL, KEY)
    test = test.cache()
    results = MD.compare(train, LABEL, folds)
    board = MD.at_once(spark, [lambda r=r: MD.holdout_row(r["model"], test, LABEL, r["name"], r["cv_auc"], KEY)
                               for r in results])
    test.unpersist()
    sp.unpersist()
    best = max(results, key=lambda r: (r["cv_auc"], r["name"]))
    return {"mart": everyone, "train": train, "test": test, "folds": folds, "results": results,
            "board": board, "best": best}


@register("train_leaderboard")
def q_train_leaderboard(spark, sf_dir):
    """Model, CV AUC, and holdout Accuracy / AUC / Recall / Precision / F1 (ML3, ML4)."""
    t = training(spark, sf_dir)
    return spark.createDataFrame(t["board"], "model string, cv_auc double, accuracy double, "
                                             "auc double, recall double, precision double, "
                                             "f1 double")


@register("tuned_scores")
def q_tuned_scores(spark, sf_dir):
    """Tuned winner (kept only if better) scoring every customer (ML5, ML7)."""
    t = training(spark, sf_dir)
    model, auc, improved = MD.tune(t["best"], t["train"], LABEL, t["folds"])
    s = MD.positive_score(model.transform(t["mart"]))
    return s.select(KEY, LABEL, "score", F.lit(t["best"]["name"]).alias("model"),
                    F.lit(auc).alias("cv_auc"), F.lit(improved).alias("tuned"))


@register("calibrated_scores")
def q_calibrated_scores(spark, sf_dir):
    """Isotonic calibration fit on out-of-fold train scores, applied to all (ML6)."""
    t = training(spark, sf_dir)
    oof = MD.out_of_fold_scores(t["best"], t["train"], LABEL, t["folds"], KEY)
    iso = MD.isotonic(oof, LABEL)
    s = MD.positive_score(t["best"]["model"].transform(t["mart"])).select(KEY, LABEL, "score")
    return s.withColumn("calibrated", iso.calibrate(F.col("score")))


CARD_CELLS = 100


@register("isotonic_calibration", f"""WITH {SCORED_SQL},
g AS (SELECT CAST(LEAST(FLOOR(score * {CARD_CELLS}), {CARD_CELLS - 1}) AS INTEGER) AS cell, COUNT(*) AS n,
             COUNT(*) FILTER (WHERE churn = 1) AS pos FROM scored GROUP BY 1),
c AS (SELECT cell, SUM(n) OVER w AS cn, SUM(pos) OVER w AS cp, n, pos FROM g WINDOW w AS (ORDER BY cell)),
-- the fit at a cell: over all runs around it, the greatest over starts of the least over ends
runs AS (SELECT a.cell AS at, b.cell AS upto,
                CAST(b.cp - a.cp + a.pos AS DOUBLE) / (b.cn - a.cn + a.n) AS rate
         FROM c a JOIN c b ON a.cell <= b.cell),
least_ AS (SELECT c.cell, r.at, MIN(rate) AS rate FROM c JOIN runs r ON r.at <= c.cell AND r.upto >= c.cell
           GROUP BY 1, 2),
fit AS (SELECT cell, MAX(rate) AS calibrated FROM least_ GROUP BY 1)
SELECT customer_id, score, calibrated FROM scored
JOIN fit ON fit.cell = CAST(LEAST(FLOOR(score * {CARD_CELLS}), {CARD_CELLS - 1}) AS INTEGER)""")
def q_isotonic_calibration(spark, sf_dir):
    """Scorecard scores calibrated to the observed churn rate by pooling adjacent cells (ML6)."""
    s = build_scored(spark, sf_dir)
    return s.select(KEY, "score", MD.isotonic(s, LABEL, cells=CARD_CELLS).calibrate(F.col("score"))
                    .alias("calibrated"))


@register("feature_selection")
def q_feature_selection(spark, sf_dir):
    """Random-forest importances, cumulative share, keep until 98 % (>= 5) (DQ19)."""
    t = training(spark, sf_dir)
    rf = [r for r in t["results"] if r["name"] == "Random Forest"][0]
    rows = MD.select_by_importance(MD.importances(rf["model"], t["train"]))
    return spark.createDataFrame(rows, "feature string, importance double, "
                                       "cumulative_share double, kept boolean")


@register("model_agreement")
def q_model_agreement(spark, sf_dir):
    """Spread of holdout AUC across the top models; < 0.03 means they agree (AG14)."""
    t = training(spark, sf_dir)
    sd, agree = MD.agreement([r[3] for r in t["board"]])
    return spark.createDataFrame([(sd, agree, len(t["board"]))],
                                 "auc_std double, models_agree boolean, n_models int")


@register("adaptive_folds", f"""WITH {MART_SQL}, f AS (SELECT SUM(churn) AS pos, COUNT(*) AS n FROM mart)
SELECT pos, n, CASE WHEN pos < 50 THEN 3 WHEN pos < 100 OR pos / CAST(n AS DOUBLE) < {d(0.05)} THEN 5
       WHEN n < 1000 THEN 5 WHEN n < 5000 THEN 7 ELSE 10 END AS n_folds FROM f""")
def q_adaptive_folds(spark, sf_dir):
    """Fold count from positives, rate and rows (ML2)."""
    m = build_mart(spark, sf_dir)
    st = m.agg(F.sum(LABEL).alias("pos"), F.count(F.lit(1)).alias("n")).first()
    return spark.createDataFrame([(int(st["pos"]), int(st["n"]),
                                   features.adaptive_folds(int(st["pos"]), int(st["n"])))],
                                 "pos bigint, n bigint, n_folds int")
