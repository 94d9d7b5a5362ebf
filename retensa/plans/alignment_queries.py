"""New customer rows of other columns than the model's, aligned by a saved stage (PRJ13, PRJ14)."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.alignment import ColumnAlignment
from ..sources import sinks
from .mart import MART_DIRTY_SQL, MART_SQL, build_mart_dirty
from .registry import register
from .sqlgen import d

KEY = "customer_id"
INPUTS = ["account_balance", "tenure_days", "days_since_last_order", "order_count", "total_revenue",
          "usage_quantity", "complaint_ratio", "avg_discount", "urgent_share", "segment",
          "main_priority", "priority_customer"]


def arriving_rows(spark, sf_dir) -> DataFrame:
    """The dirty mart as another system might send it: one model column is missing, one column is
    new, revenue is text with bad values, segments have blanks and an unknown level."""
    k = F.col(KEY)
    return build_mart_dirty(spark, sf_dir).select(
        F.lit("spring").alias("campaign"), KEY, "main_priority", "urgent_share", "account_balance",
        "tenure_days", "days_since_last_order", "order_count", "complaint_ratio", "avg_discount",
        F.when(k % 9 == 0, "n/a").otherwise(F.floor("total_revenue").cast("string")).alias("total_revenue"),
        F.when(k % 5 == 0, " new  segment ").otherwise(F.concat(F.lit("  "), "segment", F.lit(" "))).alias("segment"),
        F.when(k % 8 == 0, "maybe").otherwise(F.concat(F.lit(" "), F.upper("priority_customer")))
        .alias("priority_customer"))


ALIGNED_SQL = f"""{MART_SQL}, {MART_DIRTY_SQL},
aligned AS (
  SELECT customer_id, COALESCE(account_balance, {d(0)}) AS account_balance, tenure_days,
         days_since_last_order, order_count,
         CASE WHEN customer_id % 9 = 0 THEN {d(0)} ELSE FLOOR(total_revenue) END AS total_revenue,
         {d(0)} AS usage_quantity, COALESCE(complaint_ratio, {d(0)}) AS complaint_ratio,
         CASE WHEN isinf(avg_discount) OR avg_discount IS NULL THEN {d(0)} ELSE avg_discount END AS avg_discount,
         COALESCE(urgent_share, {d(0)}) AS urgent_share,
         CASE WHEN customer_id % 5 = 0 THEN 'Unknown' ELSE COALESCE(segment, 'Unknown') END AS segment,
         COALESCE(replace(main_priority, ' ', '_'), 'Unknown') AS main_priority,
         CASE WHEN customer_id % 8 <> 0 AND priority_customer = 'Yes' THEN 1 ELSE 0 END AS priority_customer
  FROM mart_dirty)"""


def saved_and_loaded(spark, stages: list, name: str) -> PipelineModel:
    return sinks.load_model(sinks.save_model(PipelineModel(stages), sinks.shared_path(spark, name)))


def fitted_aligner(spark, sf_dir):
    return ColumnAlignment(inputCols=INPUTS, carried=[KEY]).fit(build_mart_dirty(spark, sf_dir))


@register("align_model_columns", f"WITH {ALIGNED_SQL}\nSELECT * FROM aligned")
def q_align_model_columns(spark, sf_dir):
    """Arriving rows in the model's columns, types and levels, by a saved and loaded stage."""
    model = saved_and_loaded(spark, [fitted_aligner(spark, sf_dir)], "aligner")
    return model.transform(arriving_rows(spark, sf_dir))
