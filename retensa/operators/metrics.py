"""Exact, distributed evaluation metrics (ML10-ML18, WN6, ML15).

Everything that needs a global order (AUC, Youden, gains, lift) first
collapses the scored table to one row per distinct score with positive and
negative counts (a partial aggregate), then runs the distributed running sum
of ``functions.ordering`` over those rows.  No metric pulls rows to the
driver; only scalars come back.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import ordered_cumsum
from ..session import reliable_checkpoint

# ---- fixed values (must equal the reference's) -------------------------------
DEFAULT_THRESHOLD = 0.35
FALLBACK_THRESHOLD = 0.25
MIN_AT_RISK = 20
CLIP_LO, CLIP_HI = 0.001, 0.999
CONF_HIGH, CONF_MEDIUM = 0.25, 0.10
YOUDEN_MIN, YOUDEN_MAX = 0.1, 0.9
LIFT_TIERS = [0.10, 0.20, 0.30, 0.40, 0.50]
TEST_LEAK_CEILING = 0.97
RANDOM_AUC = 0.50 + 0.02
WEAK_AUC = 0.58
F1_CRITICAL, F1_WARNING = 0.20, 0.35
GEN_LOW, GEN_MODERATE = 0.05, 0.10
NEAR_PERFECT = 0.995
# ------------------------------------------------------------------------------


def gain_steps() -> list[float]:
    """1 %, 2 %, ... 100 % exactly as numpy.arange(0.01, 1.01, 0.01) yields them."""
    return [float(x) for x in np.arange(0.01, 1.01, 0.01)]


def calibration_edges(n_bins: int) -> list[float]:
    return [float(x) for x in np.linspace(0.0, 1.0, n_bins + 1)]


def confusion(df: DataFrame, y: str, p: str, threshold: float, strict: bool = True) -> DataFrame:
    """tp, fp, tn, fn and accuracy / precision / recall / f1 / specificity."""
    pred = (F.col(p) > threshold) if strict else (F.col(p) >= threshold)
    yy = F.col(y) == 1
    c = df.agg(F.count_if(pred & yy).alias("tp"), F.count_if(pred & ~yy).alias("fp"),
               F.count_if(~pred & ~yy).alias("tn"), F.count_if(~pred & yy).alias("fn"))
    return with_rates(c)


def with_rates(c: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(x).cast("double") for x in ("tp", "fp", "tn", "fn"))
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    return c.select(
        "*", ((tp + tn) / (tp + fp + tn + fn)).alias("accuracy"), prec.alias("precision"),
        rec.alias("recall"),
        F.when(prec + rec > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0).alias("f1"),
        F.when(tn + fp > 0, tn / (tn + fp)).otherwise(0.0).alias("specificity"))


def score_counts(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row per distinct score: positives and negatives (map-side combined)."""
    return df.groupBy(F.col(p).alias("s")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg"))


def auc(df: DataFrame, y: str, p: str) -> float | None:
    """Rank-formula AUC with average ties, over distinct scores."""
    sc = score_counts(df, y, p)
    cum = ordered_cumsum(sc, ["s"], {"cneg": "neg"})
    r = cum.agg(F.sum(F.col("pos") * (F.col("cneg") - F.col("neg") + 0.5 * F.col("neg")))
                .alias("num"), F.sum("pos").alias("P"), F.sum("neg").alias("N")).first()
    if not r["P"] or not r["N"]:
        return None
    return float(r["num"]) / (float(r["P"]) * float(r["N"]))


def split_metrics(df: DataFrame, split: str, y: str, p: str, threshold: float,
                  strict: bool = True) -> DataFrame:
    """Per split: the confusion counts and rates, AUC (null with one class), n and the positive rate.

    The rows are counted once by (split, score, label); all of it follows from these counts
    and one running count over (split, score).
    """
    counts = reliable_checkpoint(df.groupBy(F.col(split), F.col(p).alias("s")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg")))
    cum = ordered_cumsum(counts, [split, "s"], {"cneg": "neg"})
    pred = (F.col("s") > threshold) if strict else (F.col("s") >= threshold)

    def total(c: str, which: Column | None = None) -> Column:
        return F.sum(F.col(c) if which is None else F.when(which, F.col(c)).otherwise(0))

    c = cum.groupBy(split).agg(
        total("pos", pred).alias("tp"), total("neg", pred).alias("fp"),
        total("neg", ~pred).alias("tn"), total("pos", ~pred).alias("fn"),
        F.sum(F.col("pos") * (F.col("cneg") - F.col("neg") / 2.0)).alias("below"),
        F.min(F.col("cneg") - F.col("neg")).alias("before"))
    pos, neg = F.col("tp") + F.col("fn"), F.col("fp") + F.col("tn")
    auc_value = F.when((pos > 0) & (neg > 0), (F.col("below") - pos * F.col("before")) / (
        pos.cast("double") * neg))
    return with_rates(c.withColumns({"auc": auc_value, "n": pos + neg, "rate": pos / (pos + neg)}).drop(
        "below", "before"))


def youden(df: DataFrame, y: str, p: str, lo: float = YOUDEN_MIN, hi: float = YOUDEN_MAX) -> dict:
    """Threshold maximising tpr - fpr over distinct scores (descending); the
    first (highest) score wins ties; no positive J keeps the +inf start."""
    sc = score_counts(df, y, p)
    cum = ordered_cumsum(sc, ["s"], {"cpos": "pos", "cneg": "neg"}, descending=True)
    tot = sc.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).first()
    P, N = float(tot["P"] or 0), float(tot["N"] or 0)
    if P == 0 or N == 0:
        return {"raw_threshold": None, "best_j": None, "threshold": DEFAULT_THRESHOLD}
    j = F.col("cpos") / F.lit(P) - F.col("cneg") / F.lit(N)
    best = cum.agg(F.max_by(F.struct(j.alias("j"), F.col("s")), F.struct(j, F.col("s")))
                   .alias("b")).first()["b"]
    if best is None or best["j"] <= 0:
        raw, bj = float("inf"), 0.0
    else:
        raw, bj = float(best["s"]), float(best["j"])
    return {"raw_threshold": raw, "best_j": bj, "threshold": max(lo, min(hi, raw))}


def ranked_positives(df: DataFrame, y: str, p: str, key: str) -> DataFrame:
    """Row number by score desc (ties by key) and running count of positives."""
    base = df.select(F.col(key), F.col(p).alias("s"), F.col(y).cast("long").alias("y"))
    return ordered_cumsum(base.withColumn("one", F.lit(1).cast("long")),
                          ["s", key], {"k": "one", "captured": "y"},
                          descending=[True, False])


def cut_table(df: DataFrame, y: str, p: str, key: str, fracs: list[float],
              name: str) -> DataFrame:
    """Captured positives in the top max(1, int(f * n)) rows for each f."""
    n = df.count()
    P = df.agg(F.sum(F.col(y).cast("long"))).first()[0] or 0
    ks = {}
    for i, f in enumerate(fracs):
        ks.setdefault(max(1, int(f * n)), []).append((i, f))
    kt = df.sparkSession.createDataFrame(
        [(k, i + 1, f) for k, lst in ks.items() for i, f in lst],
        f"k long, {name}_index int, {name} double")
    rp = ranked_positives(df, y, p, key).select("k", "captured")
    out = rp.join(F.broadcast(kt), "k")            # <= len(fracs) rows on the small side
    return out.withColumn("positives", F.lit(P).cast("long"))


def calibration_bins(df: DataFrame, y: str, p: str, n_bins: int) -> DataFrame:
    """Uniform bins like sklearn calibration_curve: bin = #inner edges < p."""
    edges = calibration_edges(n_bins)[1:-1]
    b = sum((F.col(p) > F.lit(e)).cast("int") for e in edges) if edges else F.lit(0)
    return df.groupBy(b.alias("bin")).agg(F.avg(F.col(p)).alias("mean_predicted"),
                                          F.avg(F.col(y).cast("double")).alias("fraction_positive"),
                                          F.count(F.lit(1)).alias("count"))


def verdict(train: dict, test: dict, n_test: int, test_rate: float, ensemble: bool = False) -> dict:
    """Train/test verdict rules (ML16) on scalar metric dicts."""
    gaps = {k: train[k] - test[k] for k in ("accuracy", "f1", "auc")}
    natural = 1.5 / np.sqrt(max(n_test, 1))
    minority = min(test_rate, 1 - test_rate)
    expected = natural + (0.06 if ensemble else 0.0) + max(0.0, (0.1 - minority) * 0.5)
    severe, moderate = min(0.30, 3.5 * expected), min(0.20, 2.0 * expected)
    issues, warns = [], []
    train_ceiling = float("inf") if ensemble else TEST_LEAK_CEILING
    if test["auc"] > TEST_LEAK_CEILING or train["auc"] > train_ceiling:
        issues += ["leakage_signal", "review_features_after_event"]
    elif ensemble and train["auc"] > 0.95:
        warns.append("ensemble_train_auc_elevated")
    if gaps["auc"] > severe or gaps["f1"] > severe:
        issues.append("severe_overfitting")
    elif gaps["auc"] > moderate or gaps["f1"] > moderate:
        warns.append("moderate_overfitting")
    if test["auc"] < RANDOM_AUC:
        issues.append("random_model")
    elif test["auc"] < WEAK_AUC:
        warns.append("weak_model")
    if test["f1"] < F1_CRITICAL:
        issues.append("f1_critical")
    elif test["f1"] < F1_WARNING:
        warns.append("f1_low")
    status = "CRITICAL" if issues else ("WARNING" if warns else "HEALTHY")
    g = gaps["auc"]
    gen = "Low" if g < GEN_LOW else ("Moderate" if g < GEN_MODERATE else "High")
    near = all(test[k] >= NEAR_PERFECT for k in ("accuracy", "precision", "recall", "f1", "auc"))
    return {"gaps": gaps, "expected_gap": float(expected), "severe": float(severe),
            "moderate": float(moderate), "issues": issues, "warnings": warns,
            "status": status, "generalisation": gen, "near_perfect": near}


def clip_probability(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(CLIP_LO)), F.lit(CLIP_HI))


def confidence(p: Column, thr: float) -> Column:
    dist = F.abs(p - F.lit(thr))
    return F.when(dist > CONF_HIGH, "High").when(dist > CONF_MEDIUM, "Medium").otherwise("Low")
