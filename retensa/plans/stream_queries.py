"""Streams run to their end inside a query, with a restart, against the batch result (SX1, SX2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import sinks
from ..sources.tables import table
from ..streaming.events import run_to_parquet
from ..streaming.scoring import score_new_files
from .alignment_queries import ALIGNED_SQL, KEY, arriving_rows, fitted_aligner, saved_and_loaded
from .registry import register
from .scored import CATEGORY_COLUMNS, NUMERIC_WEIGHTS, ScorecardStage, prob_sql, scorecard


def _stream_scoring_sql():
    stats = ", ".join(f"AVG({c}) AS m_{c}, STDDEV_SAMP({c}) AS s_{c}" for c in NUMERIC_WEIGHTS)
    values = {c: f"aligned.{c}" for c in [*NUMERIC_WEIGHTS, *CATEGORY_COLUMNS]}
    return (f"WITH {ALIGNED_SQL},\nsc_stats AS (SELECT {stats} FROM mart)\n"
            f"SELECT customer_id, {prob_sql(values)} AS score FROM aligned, sc_stats")


@register("stream_scoring", _stream_scoring_sql())
def q_stream_scoring(spark, sf_dir):
    """Arriving files scored by a saved pipeline that aligns them first: two runs with one
    checkpoint, the second of which finds the files that came after the first (SX1)."""
    model = saved_and_loaded(spark, [fitted_aligner(spark, sf_dir),
                                     ScorecardStage.of(scorecard(spark, sf_dir))], "scorer")
    rows = arriving_rows(spark, sf_dir)
    files, out, progress = (sinks.shared_path(spark, n) for n in ("arriving", "scores", "progress"))
    early = F.pmod(F.xxhash64(KEY), F.lit(2)) == 0
    for part in (rows.where(early), rows.where(~early)):
        part.write.mode("append").parquet(files)
        score_new_files(spark, model, rows.schema, files, out, progress)
    return spark.read.parquet(out)


@register("stream_rfm_events", """
WITH closed AS (SELECT max(ts) - INTERVAL 1 DAY AS until FROM events),
daily AS (
  SELECT user_id, CAST(ts AS DATE) AS day, COUNT(*) AS events,
         COUNT(*) FILTER (WHERE event_type = 'purchase') AS purchases,
         SUM(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END) AS purchase_value,
         epoch_us(max(ts)) AS last_event_us
  FROM events GROUP BY 1, 2)
SELECT daily.* REPLACE (CAST(day AS VARCHAR) AS day)
FROM daily, closed WHERE CAST(day AS TIMESTAMP) + INTERVAL 1 DAY <= until""")
def q_stream_rfm_events(spark, sf_dir):
    """Daily R/F/M inputs per user from a stream of event files in two runs.  Every seventh event
    of the last half day before the cut comes late, in the second run: the watermark's delay is a day,
    so all of them still count.  Days that the watermark has passed are in the result (SX2)."""
    events = table(spark, sf_dir, "events")
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    if first is None:
        return spark.createDataFrame([], "user_id long, day string, events long, purchases long, "
                                         "purchase_value double, last_event_us long")
    cut = first + (last - first) / 2
    half_day = F.expr("INTERVAL 12 HOURS")
    late = (F.col("ts") > F.lit(cut) - half_day) & (F.pmod(F.xxhash64("event_id"), F.lit(7)) == 0)
    early = (F.col("ts") <= F.lit(cut)) & ~late
    files, out, progress = (sinks.shared_path(spark, n) for n in ("events", "daily", "progress"))
    for part in (events.where(early), events.where(~early)):
        part.write.mode("append").parquet(files)
        run_to_parquet(spark, files, events.schema, out, progress)
    return spark.read.parquet(out).select(
        "user_id", F.to_date("day.start").cast("string").alias("day"), "events", "purchases", "purchase_value",
        F.unix_micros("last_event").alias("last_event_us"))
