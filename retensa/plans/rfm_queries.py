"""RFM queries over the customer mart and the event mart."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numeric import round_half_up, sql_round_half_up
from ..operators import rfm
from .mart import EVENT_MART_SQL, MART_SQL, build_event_mart, build_mart
from .registry import register
from .sqlgen import d, quintile_ctes, quintile_score

SEG_ARRAY_SQL = "['At_Risk', 'Developing', 'Established', 'Champions']"


def _rfm_sql(table: str, key: str, m: str, f: str, r: str, r_reverse: bool, keep: str = "",
             check_r: bool = False) -> str:
    """CTEs up to ``seg`` (scores, composite, segment) for fixed M/F/R columns.
    With ``check_r`` the recency column is used only when it has more than two
    distinct values and a positive spread (the column-choice rule)."""
    has_r = (f"(SELECT COUNT(DISTINCT {r}) > 2 AND STDDEV_SAMP({r}) > {d(1e-9)} FROM {table})"
             if check_r else "TRUE")
    comp_r = (f"((rfm_monetary_score * {d(0.4)} + rfm_frequency_score * {d(0.3)})"
              f" + rfm_recency_score * {d(0.3)}) / {d(1.0)}")
    comp_nr = f"(rfm_monetary_score * {d(0.4)} + rfm_frequency_score * {d(0.3)}) / {d(0.4 + 0.3)}"
    return f"""{quintile_ctes('qm', table, m)},
{quintile_ctes('qf', table, f)},
{quintile_ctes('qr', table, r)},
hr AS (SELECT {has_r} AS has_r),
sc AS (SELECT {key}{keep},
    CAST({m} AS DOUBLE) AS rfm_monetary_value, {quintile_score('qm', m, False)} AS rfm_monetary_score,
    CAST({f} AS DOUBLE) AS rfm_frequency_value, {quintile_score('qf', f, False)} AS rfm_frequency_score,
    CASE WHEN has_r THEN CAST({r} AS DOUBLE) END AS rfm_recency_value,
    CASE WHEN has_r THEN {quintile_score('qr', r, r_reverse)} END AS rfm_recency_score, has_r
  FROM {table}, qm_s, qf_s, qr_s, hr),
comp AS (SELECT * EXCLUDE (has_r), CASE WHEN has_r THEN {comp_r} ELSE {comp_nr} END AS rfm_composite_score FROM sc),
seg AS (SELECT *, {SEG_ARRAY_SQL}[CASE WHEN n <= 1 THEN 2
                   ELSE GREATEST((4 * (rfm_rank - 1) + n - 2) // (n - 1), 1) END] AS rfm_segment
        FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY rfm_composite_score, {key}) AS rfm_rank,
                     COUNT(*) OVER () AS n FROM comp) t)"""


MART_RFM_SQL = _rfm_sql("mart", "customer_id", "total_revenue", "order_count",
                        "days_since_last_order", True, keep=", churn")
EVENT_RFM_SQL = _rfm_sql("event_mart", "user_id", "total_value", "purchase_count",
                         "days_since_last_event", True, check_r=True)

SCORE_COLS = ("rfm_monetary_value, rfm_monetary_score, rfm_frequency_value, "
              "rfm_frequency_score, rfm_recency_value, rfm_recency_score, rfm_composite_score")


def mart_rfm_scores(spark, sf_dir, keep=("churn",)):
    mart = build_mart(spark, sf_dir)
    return rfm.rfm_scores(mart, "customer_id", target="churn", keep=list(keep))


def mart_rfm_segments(spark, sf_dir, keep=("churn",)):
    return rfm.rfm_segments(mart_rfm_scores(spark, sf_dir, keep), "customer_id")


@register("rfm_scores", f"""WITH {MART_SQL}, {MART_RFM_SQL}
SELECT customer_id, {SCORE_COLS} FROM comp""")
def q_rfm_scores(spark, sf_dir):
    return mart_rfm_scores(spark, sf_dir, keep=())


@register("rfm_segments", f"""WITH {MART_SQL}, {MART_RFM_SQL}
SELECT customer_id, rfm_composite_score, CAST(rfm_rank AS BIGINT) AS rfm_rank, rfm_segment,
  CAST(rfm_segment = 'At_Risk' AS INTEGER) AS rfm_seg_at_risk,
  CAST(rfm_segment = 'Developing' AS INTEGER) AS rfm_seg_developing,
  CAST(rfm_segment = 'Established' AS INTEGER) AS rfm_seg_established,
  CAST(rfm_segment = 'Champions' AS INTEGER) AS rfm_seg_champions
FROM seg""")
def q_rfm_segments(spark, sf_dir):
    s = mart_rfm_segments(spark, sf_dir, keep=())
    return s.select("customer_id", "rfm_composite_score", "rfm_rank", "rfm_segment",
                    *[f"rfm_seg_{x.lower()}" for x in rfm.SEGMENTS])


def rfm_distribution(seg_df):
    """Segment count, share of customers (1 decimal) and churn rate (AG2)."""
    g = seg_df.groupBy("rfm_segment").agg(F.count(F.lit(1)).alias("customers"),
                                          F.avg("churn").alias("churn_rate"))
    total = F.sum("customers").over(Window.partitionBy())  # <= 4 rows
    return g.select("rfm_segment", "customers",
                    round_half_up(F.col("customers") * 100.0 / total, 1).alias("pct"),
                    "churn_rate")


RFM_DISTRIBUTION_SQL = f"""WITH {MART_SQL}, {MART_RFM_SQL}
SELECT rfm_segment, COUNT(*) AS customers,
  {sql_round_half_up("COUNT(*) * 100.0 / SUM(COUNT(*)) OVER ()", 1)} AS pct,
  AVG(churn) AS churn_rate
FROM seg GROUP BY rfm_segment"""


@register("rfm_distribution", RFM_DISTRIBUTION_SQL)
def q_rfm_distribution(spark, sf_dir):
    return rfm_distribution(mart_rfm_segments(spark, sf_dir))


@register("rfm_segment_sample", f"""WITH {MART_SQL}, {MART_RFM_SQL},
cnt AS (SELECT rfm_segment, COUNT(*) AS c FROM seg GROUP BY rfm_segment),
pick AS (SELECT s.*, c, ROW_NUMBER() OVER (PARTITION BY s.rfm_segment ORDER BY customer_id) AS rn
         FROM seg s JOIN cnt USING (rfm_segment))
SELECT rfm_segment, customer_id, {SCORE_COLS} FROM pick WHERE rn <= 2
ORDER BY c DESC, rfm_segment, customer_id LIMIT 10""")
def q_rfm_segment_sample(spark, sf_dir):
    """First two customers (by key) of every segment, segments by size, then
    the first ten rows (WN5)."""
    s = mart_rfm_segments(spark, sf_dir, keep=())
    sizes = s.groupBy("rfm_segment").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("rfm_segment").orderBy("customer_id")
    # top-2 per group: Spark plans this as a per-partition group limit before the
    # shuffle (WindowGroupLimit), so a hot segment does not move all its rows
    firsts = s.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= 2)
    return (firsts.join(F.broadcast(sizes), "rfm_segment")   # <= 4 rows
            .orderBy(F.col("c").desc(), "rfm_segment", "customer_id").limit(10)
            .select("rfm_segment", "customer_id", *[c.strip() for c in SCORE_COLS.split(",")]))


@register("rfm_events", f"""WITH {EVENT_MART_SQL}, {EVENT_RFM_SQL}
SELECT user_id, {SCORE_COLS}, rfm_segment FROM seg""")
def q_rfm_events(spark, sf_dir):
    em = build_event_mart(spark, sf_dir)
    sc = rfm.rfm_scores(em, "user_id")
    seg = rfm.rfm_segments(sc, "user_id")
    # stable schema: a dimension the column choice rejected comes out as nulls
    types = {"value": "double", "score": "int"}
    for dim in ("monetary", "frequency", "recency"):
        for part, t in types.items():
            c = f"rfm_{dim}_{part}"
            if c not in seg.columns:
                seg = seg.withColumn(c, F.lit(None).cast(t))
    return seg.select("user_id", *[c.strip() for c in SCORE_COLS.split(",")], "rfm_segment")


@register("rfm_column_choice", """SELECT * FROM (VALUES ('monetary', 'total_revenue'),
  ('frequency', 'order_count'), ('recency', 'days_since_last_order')) t(dimension, column_name)""")
def q_rfm_column_choice(spark, sf_dir):
    return rfm.column_choice_frame(build_mart(spark, sf_dir), target="churn")


@register("rfm_summary", """SELECT * FROM (VALUES ('monetary', 'total_revenue', TRUE, FALSE, 1.0::DOUBLE),
  ('frequency', 'order_count', TRUE, FALSE, 1.0::DOUBLE),
  ('recency', 'days_since_last_order', TRUE, TRUE, 1.0::DOUBLE))
  t(dimension, source_column, detected, reverse, coverage)""")
def q_rfm_summary(spark, sf_dir):
    """Sources, detected dimensions, direction and coverage = found / 3 (RF5)."""
    return rfm.rfm_summary(spark, rfm.fit_rfm(build_mart(spark, sf_dir), target="churn"))
