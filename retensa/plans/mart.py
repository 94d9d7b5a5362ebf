"""Customer mart built from customer / orders / lineitem (fixture B1), its dirty
variant (B2) and the fixed-scorecard ``scored`` table (B3).

Every builder has a DuckDB SQL twin (``*_SQL``) used as the correctness oracle.

Scale notes: lineitem (the largest table) is pre-aggregated per order with a
map-side partial aggregate before it meets orders; all customer-level pieces
are aggregated on the customer key so the final joins share one hash
partitioning.  ``nation`` is left to Spark's size check.
Money is summed as exact integers (cents x basis points) so both engines
agree to the last digit without the slow wide-DECIMAL aggregation path.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import reliable_checkpoint
from ..sources.derived import DERIVED
from ..sources.tables import table

CUTOFF = "2000-08-01"

MART_COLUMNS = ["customer_id", "segment", "nation", "account_balance", "tenure_days",
                "days_since_last_order", "order_count", "total_revenue",
                "avg_order_value", "monthly_charges", "usage_quantity",
                "complaint_ratio", "avg_discount", "urgent_share", "main_priority",
                "churn"]


#: the tables that the customer mart and all that is made from it read
MART_TABLES = ("customer", "lineitem", "nation", "orders")


def cached(spark: SparkSession, key: tuple, build, tables: tuple[str, ...] = MART_TABLES) -> DataFrame:
    """Persist a derived table, ``key`` = (name, folder, ...), until the files of its tables change
    (memory, spilling to disk).  Lost blocks are recomputed from the deterministic lineage."""
    return DERIVED.get(spark, key[1], key, tables,
                       lambda: build().persist(StorageLevel.MEMORY_AND_DISK), DataFrame.unpersist)


def kept_small(spark: SparkSession, key: tuple, build, tables: tuple[str, ...] = MART_TABLES) -> DataFrame:
    """A derived table whose number of rows is a parameter, written once to the shared checkpoint
    folder until the files of its tables change.  A persisted table carries the plans of all that it
    was made from into every plan built on it; this one is a leaf."""
    return DERIVED.get(spark, key[1], key, tables, lambda: reliable_checkpoint(build()))


def clear_cache() -> None:
    """Drop every derived table and model (benchmarks time queries from cold)."""
    DERIVED.clear()


def build_mart(spark: SparkSession, sf_dir: str, cutoff: str = CUTOFF) -> DataFrame:
    """The customer mart, persisted for the application."""
    return cached(spark, ("mart", sf_dir, cutoff), lambda: mart_plan(spark, sf_dir, cutoff))


def mart_plan(spark: SparkSession, sf_dir: str, cutoff: str = CUTOFF) -> DataFrame:
    cut = F.to_date(F.lit(cutoff))
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", F.to_date("o_orderdate").alias("od"),
        "o_orderpriority")
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")

    # money in exact integers: cents x (100 - discount in basis points) is the
    # revenue in 1e-4 units; one correctly rounded division at the end
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    disc_bp = F.round(F.col("l_discount") * 100).cast("long")
    per_order_lines = lines.groupBy("l_orderkey").agg(
        F.sum(cents * (F.lit(100) - disc_bp)).alias("rev"),
        F.sum("l_quantity").alias("qty"),
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(F.col("l_returnflag") == "R").alias("n_returned"),
        F.sum(disc_bp).alias("disc"))

    # to_date(ts) < day  <=>  ts < day 00:00, written on the raw column so the
    # predicate reaches the Parquet scan (PushedFilters)
    hist = orders.filter(F.col("o_orderdate") < F.lit(cutoff).cast("timestamp_ntz"))
    # one scan of orders for counts, dates and the most common priority
    before = F.col("od") < cut
    by_priority = orders.groupBy("o_custkey", "o_orderpriority").agg(
        F.min(F.when(before, F.col("od"))).alias("first_od"),
        F.max(F.when(before, F.col("od"))).alias("last_od"),
        F.count_if(before).alias("n"), F.count_if(~before).alias("n_future"))
    own = F.when(F.col("n") > 0, F.struct(-F.col("n"), F.col("o_orderpriority")))
    per_cust_orders = by_priority.groupBy("o_custkey").agg(
        F.min("first_od").alias("first_od"), F.max("last_od").alias("last_od"),
        F.sum("n").alias("order_count"),
        F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("n")).otherwise(0)).alias("n_urgent"),
        F.sum("n_future").alias("n_future"),
        F.min_by("o_orderpriority", own).alias("main_priority"),
    ).filter(F.col("order_count") > 0)

    per_cust_lines = (hist.select("o_orderkey", "o_custkey")
                      .join(per_order_lines, F.col("o_orderkey") == F.col("l_orderkey"))
                      .groupBy("o_custkey").agg(
                          F.sum("rev").alias("rev"), F.sum("qty").alias("qty"),
                          F.sum("n_lines").alias("n_lines"),
                          F.sum("n_returned").alias("n_returned"),
                          F.sum("disc").alias("disc")))

    cust = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    # small enough for a broadcast by its size, which the session's threshold checks
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")

    m = (per_cust_orders
         .join(cust, F.col("o_custkey") == F.col("c_custkey"))
         .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
         .join(per_cust_lines, "o_custkey", "left"))

    tenure = F.datediff(cut, F.col("first_od"))
    total_rev = F.coalesce(F.col("rev"), F.lit(0)).cast("double") / F.lit(10000.0)
    n_lines = F.coalesce(F.col("n_lines"), F.lit(0))
    return m.select(
        F.col("o_custkey").cast("long").alias("customer_id"),
        F.col("c_mktsegment").alias("segment"),
        F.col("n_name").alias("nation"),
        F.col("c_acctbal").cast("double").alias("account_balance"),
        tenure.cast("int").alias("tenure_days"),
        F.datediff(cut, F.col("last_od")).cast("int").alias("days_since_last_order"),
        F.col("order_count").cast("long").alias("order_count"),
        total_rev.alias("total_revenue"),
        (total_rev / F.col("order_count")).alias("avg_order_value"),
        (total_rev / F.greatest(tenure / F.lit(30.0), F.lit(1.0)))
        .alias("monthly_charges"),
        F.coalesce(F.col("qty"), F.lit(0.0)).cast("double").alias("usage_quantity"),
        F.when(n_lines > 0, F.col("n_returned") / n_lines)
        .alias("complaint_ratio"),
        F.when(n_lines > 0, F.col("disc").cast("double") / F.lit(100.0) / n_lines)
        .alias("avg_discount"),
        (F.col("n_urgent") / F.col("order_count")).alias("urgent_share"),
        F.col("main_priority"),
        F.when(F.col("n_future") == 0, 1).otherwise(0).cast("int").alias("churn"),
    )


MART_SQL = f"""
mart AS (
  WITH o AS (
    SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS od, o_orderpriority
    FROM orders),
  pol AS (
    SELECT l_orderkey,
           SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT) * (100 - CAST(ROUND(l_discount * 100) AS BIGINT))) AS rev,
           SUM(l_quantity) AS qty,
           COUNT(*) AS n_lines,
           COUNT(*) FILTER (WHERE l_returnflag = 'R') AS n_returned,
           SUM(CAST(ROUND(l_discount * 100) AS BIGINT)) AS disc
    FROM lineitem GROUP BY l_orderkey),
  pco AS (
    SELECT o_custkey,
           MIN(CASE WHEN od < DATE '{CUTOFF}' THEN od END) AS first_od,
           MAX(CASE WHEN od < DATE '{CUTOFF}' THEN od END) AS last_od,
           COUNT(*) FILTER (WHERE od < DATE '{CUTOFF}') AS order_count,
           COUNT(*) FILTER (WHERE od < DATE '{CUTOFF}' AND o_orderpriority = '1-URGENT') AS n_urgent,
           COUNT(*) FILTER (WHERE od >= DATE '{CUTOFF}') AS n_future
    FROM o GROUP BY o_custkey
    HAVING COUNT(*) FILTER (WHERE od < DATE '{CUTOFF}') > 0),
  pcl AS (
    SELECT o.o_custkey, SUM(rev) AS rev, SUM(qty) AS qty, SUM(n_lines) AS n_lines,
           SUM(n_returned) AS n_returned, SUM(disc) AS disc
    FROM o JOIN pol ON o.o_orderkey = pol.l_orderkey
    WHERE o.od < DATE '{CUTOFF}' GROUP BY o.o_custkey),
  pcm AS (
    SELECT o_custkey, o_orderpriority AS main_priority FROM (
      SELECT o_custkey, o_orderpriority,
             ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY COUNT(*) DESC, o_orderpriority) AS rn
      FROM o WHERE od < DATE '{CUTOFF}' GROUP BY o_custkey, o_orderpriority) t WHERE rn = 1),
  j AS (
    SELECT pco.*, c.c_mktsegment, n.n_name, c.c_acctbal, pcl.rev, pcl.qty, pcl.n_lines,
           pcl.n_returned, pcl.disc, pcm.main_priority,
           date_diff('day', pco.first_od, DATE '{CUTOFF}') AS tenure,
           CAST(COALESCE(pcl.rev, 0) AS DOUBLE) / CAST(10000 AS DOUBLE) AS total_rev,
           COALESCE(pcl.n_lines, 0) AS nl
    FROM pco JOIN customer c ON pco.o_custkey = c.c_custkey
    LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
    LEFT JOIN pcl ON pco.o_custkey = pcl.o_custkey
    LEFT JOIN pcm ON pco.o_custkey = pcm.o_custkey)
  SELECT CAST(o_custkey AS BIGINT) AS customer_id,
         c_mktsegment AS segment,
         n_name AS nation,
         CAST(c_acctbal AS DOUBLE) AS account_balance,
         CAST(tenure AS INTEGER) AS tenure_days,
         CAST(date_diff('day', last_od, DATE '{CUTOFF}') AS INTEGER) AS days_since_last_order,
         CAST(order_count AS BIGINT) AS order_count,
         total_rev AS total_revenue,
         total_rev / order_count AS avg_order_value,
         total_rev / GREATEST(tenure / 30.0, 1.0) AS monthly_charges,
         CAST(COALESCE(qty, 0) AS DOUBLE) AS usage_quantity,
         CASE WHEN nl > 0 THEN n_returned / nl END AS complaint_ratio,
         CASE WHEN nl > 0 THEN CAST(disc AS DOUBLE) / CAST(100 AS DOUBLE) / nl END AS avg_discount,
         n_urgent / order_count AS urgent_share,
         main_priority,
         CAST(CASE WHEN n_future = 0 THEN 1 ELSE 0 END AS INTEGER) AS churn
  FROM j)"""


MART_PROFILE_SQL = "profile AS (" + " UNION ALL ".join(
    f"SELECT {i} AS position, COUNT(*) - COUNT({c}) AS missing, "
    f"COALESCE(MIN({c}) < MAX({c}), FALSE) AS varies FROM mart" for i, c in enumerate(MART_COLUMNS)) + ")"


EVENT_REF_DATE = "2024-02-01"


def build_event_mart(spark: SparkSession, sf_dir: str, ref_date: str = EVENT_REF_DATE) -> DataFrame:
    return cached(spark, ("event_mart", sf_dir, ref_date),
                  lambda: event_mart_plan(spark, sf_dir, ref_date), ("events",))


def event_mart_plan(spark: SparkSession, sf_dir: str, ref_date: str = EVENT_REF_DATE) -> DataFrame:
    """One row per user from the event stream: event-based R, F and M inputs."""
    ev = table(spark, sf_dir, "events").select("user_id", "ts", "event_type", "value")
    purchase = F.col("event_type") == "purchase"
    agg = ev.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.count_if(purchase).alias("purchase_count"),
        F.sum(F.when(purchase, F.round(F.col("value") * 100).cast("long"))).alias("pv"),
        F.max(F.to_date("ts")).alias("last_day"))
    return agg.select(
        F.col("user_id").cast("long").alias("user_id"),
        F.col("event_count").cast("long").alias("event_count"),
        F.col("purchase_count").cast("long").alias("purchase_count"),
        (F.coalesce(F.col("pv"), F.lit(0)).cast("double") / F.lit(100.0)).alias("total_value"),
        F.datediff(F.to_date(F.lit(ref_date)), F.col("last_day")).cast("int")
        .alias("days_since_last_event"))


EVENT_MART_SQL = f"""
event_mart AS (
  SELECT CAST(user_id AS BIGINT) AS user_id, CAST(COUNT(*) AS BIGINT) AS event_count,
         CAST(COUNT(*) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS purchase_count,
         CAST(COALESCE(SUM(CASE WHEN event_type = 'purchase' THEN CAST(ROUND(value * 100) AS BIGINT) END), 0) AS DOUBLE) / CAST(100 AS DOUBLE) AS total_value,
         CAST(date_diff('day', MAX(CAST(ts AS DATE)), DATE '{EVENT_REF_DATE}') AS INTEGER) AS days_since_last_event
  FROM events GROUP BY user_id)"""


DIRTY_COLUMNS = ["customer_id", "segment", "nation", "account_balance", "tenure_days",
                 "days_since_last_order", "order_count", "total_revenue", "avg_order_value",
                 "monthly_charges", "usage_quantity", "complaint_ratio", "avg_discount",
                 "urgent_share", "main_priority", "churn", "sparse_score", "constant_flag",
                 "leak_copy", "leak_inverse", "priority_customer", "balance_text", "leak_stamp",
                 "leak_group"]


def build_mart_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cached(spark, ("mart_dirty", sf_dir), lambda: mart_dirty_plan(spark, sf_dir))


def mart_dirty_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture B2: the mart with defects planted by key arithmetic (no
    randomness, so Spark and SQL agree): missing balances and segments,
    infinite discounts, a 70 %-missing column, a constant column, two leak
    columns, a yes/no text column, numbers stored as text with bad values,
    and every 13th customer duplicated.  (The key arithmetic defines the
    fixture; no query filters rows by it.)"""
    m = build_mart(spark, sf_dir)
    k = F.col("customer_id")
    cols = []
    for c in MART_COLUMNS:
        if c == "account_balance":
            cols.append(F.when(k % 7 != 0, F.col(c)).alias(c))
        elif c == "segment":
            cols.append(F.when(k % 23 != 0, F.col(c)).alias(c))
        elif c == "avg_discount":
            cols.append(F.when(k % 11 == 0, F.lit(float("inf"))).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    cols += [
        F.when(k % 10 < 3, F.col("tenure_days") / F.lit(7.0)).alias("sparse_score"),
        F.lit(1).alias("constant_flag"),
        F.col("churn").alias("leak_copy"),
        (F.lit(1) - F.col("churn")).alias("leak_inverse"),
        F.when(F.col("urgent_share") > F.lit(0.2), "Yes").otherwise("No").alias("priority_customer"),
        F.when(k % 17 == 0, "n/a").when(k % 19 == 0, "12d")
        .otherwise(F.col("account_balance").cast("decimal(12,2)").cast("string"))
        .alias("balance_text"),
        # large values, small spread; and a text column that names the class
        (F.lit(1700000000.0) + F.col("churn") * 8 + k % 3).alias("leak_stamp"),
        F.when(F.col("churn") == 1, "lost").otherwise("kept").alias("leak_group"),
    ]
    d = m.select(*cols)
    return d.unionByName(d.filter(k % 13 == 0))


MART_DIRTY_SQL = """
mart_dirty0 AS (
  SELECT customer_id,
         CASE WHEN customer_id % 23 <> 0 THEN segment END AS segment, nation,
         CASE WHEN customer_id % 7 <> 0 THEN account_balance END AS account_balance,
         tenure_days, days_since_last_order, order_count, total_revenue, avg_order_value,
         monthly_charges, usage_quantity, complaint_ratio,
         CASE WHEN customer_id % 11 = 0 THEN CAST('inf' AS DOUBLE) ELSE avg_discount END AS avg_discount,
         urgent_share, main_priority, churn,
         CASE WHEN customer_id % 10 < 3 THEN tenure_days / CAST(7.0 AS DOUBLE) END AS sparse_score,
         1 AS constant_flag, churn AS leak_copy, 1 - churn AS leak_inverse,
         CASE WHEN urgent_share > CAST(0.2 AS DOUBLE) THEN 'Yes' ELSE 'No' END AS priority_customer,
         CASE WHEN customer_id % 17 = 0 THEN 'n/a' WHEN customer_id % 19 = 0 THEN '12d'
              ELSE CAST(CAST(account_balance AS DECIMAL(12,2)) AS VARCHAR) END AS balance_text,
         CAST(1700000000 AS DOUBLE) + churn * 8 + customer_id % 3 AS leak_stamp,
         CASE WHEN churn = 1 THEN 'lost' ELSE 'kept' END AS leak_group
  FROM mart),
mart_dirty AS (SELECT * FROM mart_dirty0 UNION ALL SELECT * FROM mart_dirty0 WHERE customer_id % 13 = 0)"""
