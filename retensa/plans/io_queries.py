"""Source / sink queries (rows-only checks: they touch files)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality
from ..operators.policy import run_parameters
from ..sources import sinks
from ..sources.derived import files_fingerprint
from ..sources.tables import content_fingerprint, read_any, table
from .mart import MART_TABLES
from .policy_queries import EV1_COLS, EV1_SQL, ev1
from .registry import register


@register("csv_roundtrip", f"{EV1_SQL}\nSELECT {EV1_COLS} FROM ev1t")
def q_csv_roundtrip(spark, sf_dir):
    """Policy A/B table exported as CSV to the shared folder, read back with
    the header scan and its encoding fallback (SNK1, SRC1, SRC2)."""
    path = sinks.write_csv(ev1(spark, sf_dir), sinks.shared_path(spark, "policy_ab") + ".csv")
    return read_any(spark, path, infer_schema=True)


@register("json_summary")
def q_json_summary(spark, sf_dir):
    """Run parameters, arm metrics, bootstrap summary and pairwise tests as one nested JSON
    document (SNK2)."""
    from .policy_queries import (boot, ev2_pool, q_policy_arms, q_policy_bootstrap,
                                 q_policy_pairwise)
    parts = {"run_parameters": lambda s, folder: run_parameters(ev2_pool(s, folder), boot(s, folder)),
             "arm_metrics": q_policy_arms, "bootstrap_summary": q_policy_bootstrap,
             "pairwise_tests": q_policy_pairwise}
    # one-row aggregates side by side (a union + max, no join needed)
    doc = None
    for name, table in parts.items():
        one = sinks.summary_json(table(spark, sf_dir), name)
        doc = one if doc is None else doc.unionByName(one, allowMissingColumns=True)
    doc = doc.agg(*[F.max(name).alias(name) for name in parts])
    path = sinks.write_json(doc, sinks.shared_path(spark, "summary_json"))
    return spark.read.json(path)


@register("validation_report")
def q_validation_report(spark, sf_dir):
    """Train/test verdict and leak findings as a (section, key, value,
    severity) report plus its text lines (SNK4)."""
    from .metric_queries import q_train_test_verdict
    from .quality_queries import frozen_model_frame
    v = q_train_test_verdict(spark, sf_dir)
    cols = [c for c in v.columns if c not in ("status",)]
    stack = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in cols)
    metrics = v.selectExpr(f"stack({len(cols)}, {stack}) AS (key, value)", "status") \
        .select(F.lit("verdict").alias("section"), "key", "value",
                F.when(F.col("status") == "HEALTHY", "INFO").otherwise(F.col("status"))
                .alias("severity"))
    mf = frozen_model_frame(spark, sf_dir)
    n = mf.count()
    numeric = quality.screen_numeric(mf, "churn", n)

    def section(name, leaks, value):
        return leaks.select(
            F.lit(name).alias("section"), F.col("column_name").alias("key"),
            F.format_number(value, 4).alias("value"),
            F.when(F.col("is_leak"), "CRITICAL").otherwise("INFO").alias("severity"))

    report = metrics.unionByName(section("leakage", numeric, "abs_corr")).unionByName(
        section("categorical leakage", quality.screen_categorical(mf, "churn", n), "separation"))
    return report.withColumn("line", sinks.report_line())


@register("dataset_fingerprint")
def q_dataset_fingerprint(spark, sf_dir):
    """Per table that the marts read: the fingerprint of its files' metadata, by which derived tables
    and models are kept or made anew, and an order-free one of its content (SRC3)."""
    rows = None
    for name in (*MART_TABLES, "events"):
        files = files_fingerprint(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")
        one = content_fingerprint(table(spark, sf_dir, name)).select(
            F.lit(name).alias("table_name"), F.lit(files).alias("files"), "n_rows", "fingerprint")
        rows = one if rows is None else rows.unionByName(one)
    return rows
