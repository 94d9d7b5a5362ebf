"""Run-log classification and failure report (LG1, AG15), re-aimed from a
single exception to a table of run messages: one ordered CASE over
``contains`` tests, then a grouped report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values (must equal the reference's) -------------------------------
MESSAGE_RULES = [
    ("DATA_QUALITY", ["nan", "inf", "missing", "null", "empty"]),
    ("DATA_TYPE", ["dtype", "type", "convert", "cast"]),
    ("DATA_SHAPE", ["shape", "dimension", "size mismatch"]),
    ("DATA_INDEX", ["duplicate", "index"]),
    ("CONVERGENCE", ["converge", "iteration", "max_iter"]),
    ("MEMORY", ["memory", "allocation", "ram"]),
    ("FEATURE_MISMATCH", ["feature", "column not found"]),
    ("CLASS_IMBALANCE", ["imbalance", "class", "label"]),
    ("OVERFITTING", ["overfit", "variance"]),
    ("UNDERFITTING", ["underfit", "bias"]),
    ("GPU_ISSUE", ["gpu", "cuda", "device"]),
    ("TIMEOUT", ["timeout", "time", "deadline"]),
]
TYPE_RULES = [("KEY_ERROR", "KeyError"), ("VALUE_ERROR", "ValueError")]
UNKNOWN = "UNKNOWN"
# ------------------------------------------------------------------------------


def classify(message: Column, error_type: Column) -> Column:
    low = F.lower(message)
    expr = None
    for label, words in MESSAGE_RULES:
        cond = None
        for w in words:
            c = low.contains(w)
            cond = c if cond is None else (cond | c)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    for label, t in TYPE_RULES:
        expr = expr.when(error_type.contains(t), label)
    return expr.otherwise(UNKNOWN)


def sql_classify(message: str, error_type: str) -> str:
    parts = []
    for label, words in MESSAGE_RULES:
        cond = " OR ".join(f"contains(lower({message}), '{w}')" for w in words)
        parts.append(f"WHEN {cond} THEN '{label}'")
    for label, t in TYPE_RULES:
        parts.append(f"WHEN contains({error_type}, '{t}') THEN '{label}'")
    return "CASE " + " ".join(parts) + f" ELSE '{UNKNOWN}' END"


def report(log: DataFrame, ts: str = "ts") -> DataFrame:
    """Totals per problem type with first/last occurrence and share (AG15)."""
    total = log.count()
    return log.groupBy("problem_type").agg(
        F.count(F.lit(1)).alias("n_problems"), F.min(ts).alias("first_seen"),
        F.max(ts).alias("last_seen")).withColumn(
        "share", F.col("n_problems") / F.lit(float(max(total, 1))))
