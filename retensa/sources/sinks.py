"""Sinks: CSV / JSON / Parquet exports, reports, and model persistence
(SNK1-SNK4).  Paths default to a folder under the session's shared
checkpoint directory, never a machine-local temp folder."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def shared_path(spark: SparkSession, name: str) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/exports/{name}-{uuid.uuid4().hex[:12]}"


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", "true").csv(path)
    return path


def write_parquet(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").parquet(path)
    return path


#: most rows that become one JSON text
SUMMARY_ROWS = 10_000


def summary_json(df: DataFrame, name: str = "summary", most: int = SUMMARY_ROWS) -> DataFrame:
    """A whole small table as one JSON text in one row; a larger one raises when it is run."""
    rows = F.collect_list(F.struct(*df.columns))
    return df.limit(most + 1).agg(F.when(F.count(F.lit(1)) > most, F.raise_error(F.lit(
        f"{name}: more than {most} rows for one JSON text; write the table"))).otherwise(
        F.to_json(rows)).alias(name))


def write_json(df: DataFrame, path: str) -> str:
    df.coalesce(1).write.mode("overwrite").json(path)
    return path


def report_line():
    """(section, key, value, severity) -> one text line."""
    return F.concat_ws(" | ", "severity", "section", "key", "value")


def save_model(model: PipelineModel, path: str) -> str:
    """Overwrite-save (stale files are replaced) of a fitted pipeline."""
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
