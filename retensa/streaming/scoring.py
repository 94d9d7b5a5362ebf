"""SX1: score newly arriving customer files with a saved pipeline.

File source -> ``PipelineModel.transform`` -> Parquet sink, run with the
``availableNow`` trigger so each run processes exactly the files that arrived
since the last one (progress kept in the checkpoint location).  A pipeline that begins
with a ``ColumnAligner`` takes files of other columns than it was trained on."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def score_new_files(spark: SparkSession, model: PipelineModel, schema: StructType, in_dir: str,
                    out_dir: str, checkpoint: str, key: str = "customer_id") -> None:
    """Appends (key, score) of all files in ``in_dir`` that no earlier run with this
    checkpoint has read; a run that was broken off is resumed without repeats."""
    scored = model.transform(spark.readStream.schema(schema).parquet(in_dir))
    score = F.col("score") if "score" in scored.columns else vector_to_array(F.col("probability"))[1]
    q = (scored.select(key, score.alias("score")).writeStream.format("parquet").option("path", out_dir)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
