"""Smaller operators: names and lineage, filters, lookups and joins, set
operations, scaling, tiers, top-k, sampling caps, split, run-log."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numeric import q
from ..functions.quantiles import quantiles_many
from ..operators import actions as A
from ..operators import explain as X
from ..operators import features, quality, runlog, schema
from ..operators import policy as P
from .mart import (DIRTY_COLUMNS, EVENT_MART_SQL, MART_COLUMNS, MART_DIRTY_SQL,
                   MART_PROFILE_SQL, MART_SQL,
                   build_mart, build_mart_dirty)
from .policy_queries import EV2_SQL
from .registry import register
from .rfm_queries import EVENT_RFM_SQL, MART_RFM_SQL, mart_rfm_segments
from .scored import SCORED_SQL, build_scored
from .sqlgen import d, sql_str

KEY = "customer_id"


# ------------------------------------------------------------------ names
def display_name(c: str) -> str:
    """A presentation-style header derived from a mart column (input of PRJ1-3)."""
    name = " " + c.replace("_", " ").title() + " "
    if "revenue" in c or "balance" in c or "charges" in c:
        name += "($)"
    return name


_DISPLAY = [display_name(c) for c in MART_COLUMNS]


@register("rename_columns", f"WITH {MART_SQL}, {MART_PROFILE_SQL}\n"
          "SELECT missing, varies, position, display_name, normalized_name, modelling_name, "
          "lower(trim(display_name)) AS lookup_key, lower(normalized_name) = "
          "replace(lower(trim(display_name)), ' ', '_') AS resolved_exact, "
          "regexp_matches(regexp_replace(lower(trim(normalized_name)), '\\s+', '_', 'g'), "
          f"'{'|'.join(schema.ID_PATTERNS)}') AS is_id FROM ("
          "SELECT position, display_name, "
          "regexp_replace(regexp_replace(trim(display_name), '\\s+', '_', 'g'), '[^\\w_]', '', 'g') AS normalized_name, "
          "regexp_replace(display_name, '[^0-9a-zA-Z]+', '_', 'g') AS modelling_name FROM (VALUES "
          + ", ".join(f"({i}, '{n}')" for i, n in enumerate(_DISPLAY))
          + ") t(position, display_name)) s JOIN profile USING (position)")
def q_rename_columns(spark, sf_dir):
    """Normalise presentation headers of the mart (PRJ1), modelling names
    (PRJ2), case/space-insensitive lookup (PRJ3) and ID flags (PRJ5/PRJ6)."""
    m = build_mart(spark, sf_dir)
    shown = m.toDF(*[display_name(c) for c in m.columns])
    norm = schema.normalize_columns(shown)
    rows = []
    for i, (disp, nm) in enumerate(zip(shown.columns, norm.columns)):
        key = disp.strip().lower()
        try:
            resolved = schema.resolve_column(norm, key) == nm
        except KeyError:
            resolved = False
        rows.append((i, disp, nm, schema.modelling_name(disp), key, resolved,
                     schema.is_id_like(nm)))
    names = spark.createDataFrame(rows, "position int, display_name string, normalized_name string, "
                                        "modelling_name string, lookup_key string, "
                                        "resolved_exact boolean, is_id boolean")
    return schema.with_profile(names, norm)


_NUM = [c for c in MART_COLUMNS if c not in ("customer_id", "segment", "nation", "main_priority",
                                            "churn")]


@register("feature_lineage", f"""WITH {MART_SQL},
lv AS (SELECT DISTINCT 'segment' AS base, segment AS level FROM mart
       UNION ALL SELECT DISTINCT 'main_priority', main_priority FROM mart)
SELECT feature, base_feature FROM (
  SELECT base || '_' || level AS feature, base AS base_feature FROM lv
  UNION ALL SELECT 'onehotencoder__' || base || '_' || level, base FROM lv
  UNION ALL SELECT 'x3_' || base || '_' || level, base FROM lv
  UNION ALL SELECT * FROM (VALUES {', '.join(f"('{c}', '{c}'), ('num__{c}', '{c}')" for c in _NUM)}) t(f, b)) u""")
def q_feature_lineage(spark, sf_dir):
    """Encoded feature -> source column (PRJ15) for the mart's encoder outputs."""
    m = build_mart(spark, sf_dir)
    lv = features.fit_levels(m, ["segment", "main_priority"])
    raw = [c for c in m.columns if c not in (KEY, "churn")]
    feats = []
    for b, levels in lv.items():
        for v in levels:
            feats += [f"{b}_{v}", f"onehotencoder__{b}_{v}", f"x3_{b}_{v}"]
    for c in _NUM:
        feats += [c, f"num__{c}"]
    return spark.createDataFrame([(f, X.base_feature(f, raw)) for f in feats],
                                 "feature string, base_feature string")


# ------------------------------------------------------------------ filters
@register("customer_lookup", f"""WITH {MART_SQL}
SELECT mart.* FROM mart WHERE CAST(customer_id AS VARCHAR) IN (SELECT CAST(user_id AS VARCHAR) FROM events)""")
def q_customer_lookup(spark, sf_dir):
    """Customers looked up by ID compared as text (FLT5); the IDs are the
    event stream's users, applied as a semi join."""
    m = build_mart(spark, sf_dir)
    ids = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("user_id").cast("string").alias("_id"))
    return m.join(ids, m[KEY].cast("string") == F.col("_id"), "left_semi")


def _all_null_sql(cols):
    return " AND ".join(f"{c} IS NULL" for c in cols)


@register("null_row_filters", f"""WITH {MART_SQL}, {MART_DIRTY_SQL}
SELECT COUNT(*) AS n_rows,
  COUNT(*) FILTER (WHERE {' AND '.join(f'{c} IS NOT NULL' for c in DIRTY_COLUMNS)}) AS rows_without_missing,
  COUNT(*) FILTER (WHERE NOT ({_all_null_sql(DIRTY_COLUMNS)})) AS rows_not_all_missing,
  CAST({len(DIRTY_COLUMNS)} - ({' + '.join(f'CAST(COUNT({c}) = 0 AS INTEGER)' for c in DIRTY_COLUMNS)}) AS BIGINT)
    AS columns_not_all_missing
FROM mart_dirty""")
def q_null_row_filters(spark, sf_dir):
    """dropna('any'), dropna('all') and all-missing column removal (FLT6)."""
    md = build_mart_dirty(spark, sf_dir)
    n, miss = quality.missing_counts(md)
    keep_cols = [c for c in md.columns if miss[c] < n]
    return md.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows",
        F.lit(md.dropna(how="any").count()).cast("long").alias("rows_without_missing"),
        F.lit(md.dropna(how="all").count()).cast("long").alias("rows_not_all_missing"),
        F.lit(len(keep_cols)).cast("long").alias("columns_not_all_missing"))


_NONACT_SQL = ", ".join(f"'{x}'" for x in sorted(X.NON_ACTIONABLE))


@register("modelling_columns", f"WITH {MART_SQL}\nSELECT " + ", ".join(
    f'{c} AS "{schema.modelling_name(display_name(c))}"' for c in MART_COLUMNS) + " FROM mart")
def q_modelling_columns(spark, sf_dir):
    """The mart under modelling names; a later column of the same name goes (PRJ2)."""
    m = build_mart(spark, sf_dir)
    shown = m.toDF(*[display_name(c) for c in m.columns]).withColumn("-Customer-Id-", F.lit(0))
    return schema.modelling_columns(shown)


@register("actionable_filter", f"""WITH {MART_SQL}, {MART_PROFILE_SQL}
SELECT position, feature, missing, varies,
  NOT (k IN ({_NONACT_SQL}) OR k = 'customer_id' OR suffix(k, 'id') OR contains(k, '_id')) AS actionable,
  ({' OR '.join(f"contains(lower(feature), '{w}')" for w in X.IMMUTABLE_KEYWORDS)}) AS immutable
FROM (SELECT position, feature, regexp_replace(replace(lower(trim(feature)), ' ', '_'), '[^a-z0-9_]+', '', 'g') AS k
      FROM (VALUES {', '.join(f"({i}, '{c}')" for i, c in enumerate(MART_COLUMNS) if c != 'churn')}) t(position, feature)) s
JOIN profile USING (position)""")
def q_actionable_filter(spark, sf_dir):
    """Actionability (FLT7) and immutability (FLT8) of every mart feature."""
    m = build_mart(spark, sf_dir)
    rows = [(i, c, X.is_actionable(c, [KEY]), X.is_immutable(c)) for i, c in enumerate(m.columns)
            if c != "churn"]
    return schema.with_profile(spark.createDataFrame(
        rows, "position int, feature string, actionable boolean, immutable boolean"), m)


@register("rfm_guard", f"""WITH {MART_SQL}, {MART_RFM_SQL}
SELECT mart.* FROM mart JOIN seg USING (customer_id)""")
def q_rfm_guard(spark, sf_dir):
    """The model table with RFM columns joined for reporting, then guarded: no
    ``rfm_`` feature reaches training (DQ20)."""
    m = build_mart(spark, sf_dir)
    seg = mart_rfm_segments(spark, sf_dir, keep=())
    joined = m.join(seg.select(KEY, "rfm_composite_score", "rfm_segment"), KEY)
    return features.drop_rfm(joined)


# ------------------------------------------------------------------ joins
@register("value_lookup_join", f"""WITH {MART_SQL}, {MART_DIRTY_SQL},
vocab AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {v})" for k, v in features.BINARY_MAP.items())}) t(token, code))
SELECT customer_id, priority_customer, vocab.code AS priority_code
FROM mart_dirty LEFT JOIN vocab ON vocab.token = lower(trim(priority_customer))""")
def q_value_lookup_join(spark, sf_dir):
    """Label lookup through a vocabulary table, broadcast left join, unknown -> null (JN1)."""
    md = build_mart_dirty(spark, sf_dir)
    vocab = spark.createDataFrame(list(features.BINARY_MAP.items()), "token string, code int")
    return (md.select(KEY, "priority_customer")
            .join(F.broadcast(vocab), F.lower(F.trim("priority_customer")) == F.col("token"), "left")
            .select(KEY, "priority_customer", F.col("code").alias("priority_code")))


@register("customer_rfm_join", f"""WITH {SCORED_SQL}, {EVENT_MART_SQL}, {EVENT_RFM_SQL}
SELECT scored.customer_id, scored.score, COALESCE(seg.rfm_segment, 'Unknown') AS rfm_segment
FROM scored LEFT JOIN seg ON seg.user_id = scored.customer_id""")
def q_customer_rfm_join(spark, sf_dir):
    """Customers joined to their event-based value segment by key; no match -> 'Unknown' (JN3)."""
    from .rfm_queries import q_rfm_events
    s = build_scored(spark, sf_dir)
    seg = q_rfm_events(spark, sf_dir).select(F.col("user_id").alias(KEY), "rfm_segment")
    return s.join(seg, KEY, "left").select(KEY, "score", F.coalesce("rfm_segment", F.lit("Unknown"))
                                           .alias("rfm_segment"))


# ------------------------------------------------------------------ aggregates
@register("category_target_mean", f"""WITH {MART_SQL}
SELECT 'segment' AS column_name, segment AS category, AVG(CAST(churn AS DOUBLE)) AS target_mean, COUNT(*) AS count FROM mart GROUP BY segment
UNION ALL SELECT 'nation', nation, AVG(CAST(churn AS DOUBLE)), COUNT(*) FROM mart GROUP BY nation
UNION ALL SELECT 'main_priority', main_priority, AVG(CAST(churn AS DOUBLE)), COUNT(*) FROM mart GROUP BY main_priority""")
def q_category_target_mean(spark, sf_dir):
    return quality.category_target_means(build_mart(spark, sf_dir), F.col("churn"),
                                         ["segment", "nation", "main_priority"])


def _clv_sql():
    cols = [c for c in MART_COLUMNS if any(k in c.lower() for k in A.CLV_REVENUE_KEYWORDS)]
    whens = " ".join(f"WHEN {c} >= 10 AND {c} <= 10000 THEN {c} * {d(24.0)}" for c in cols)
    return f"CASE {whens} ELSE {d(A.DEFAULT_CLV)} END"


@register("clv_tiers", f"""WITH {SCORED_SQL},
c AS (SELECT customer_id, {_clv_sql()} AS clv FROM scored),
qq AS (SELECT quantile_cont(clv, 0.33) AS p33, quantile_cont(clv, 0.66) AS p66 FROM c)
SELECT customer_id, clv, CASE WHEN clv <= p33 THEN {d(30.0)} WHEN clv <= p66 THEN {d(50.0)} ELSE {d(75.0)} END AS tier_cost
FROM c, qq""")
def q_clv_tiers(spark, sf_dir):
    """CLV cut points at p33 / p66 and tiered campaign cost 30 / 50 / 75 (AG12)."""
    s = build_scored(spark, sf_dir).select(KEY, A.clv_expr(build_scored(spark, sf_dir)).alias("clv"))
    qs = quantiles_many(s, {"c": F.col("clv")}, list(P.TIER_QUANTILES))["c"]
    return s.withColumn("tier_cost", P.tier_cost(F.col("clv"), qs[0], qs[1]))


_SCALE = ["tenure_days", "total_revenue", "usage_quantity", "complaint_ratio", "account_balance"]


@register("minmax_scale", f"""WITH {MART_SQL},
st AS (SELECT {', '.join(f'MIN({c}) AS lo_{c}, MAX({c}) AS hi_{c}' for c in _SCALE)} FROM mart)
SELECT customer_id, {', '.join(f'(CAST({c} AS DOUBLE) - lo_{c}) / (hi_{c} - lo_{c} + {d(1e-8)}) AS {c}' for c in _SCALE)}
FROM mart, st""")
def q_minmax_scale(spark, sf_dir):
    """(x - min) / (max - min + 1e-8) with the scalars from one aggregate (AG13)."""
    m = build_mart(spark, sf_dir)
    st = m.agg(*[F.min(c).alias(f"lo_{c}") for c in _SCALE],
               *[F.max(c).alias(f"hi_{c}") for c in _SCALE]).first()
    return m.select(KEY, *[((F.col(c).cast("double") - F.lit(float(st[f"lo_{c}"])))
                            / (F.lit(float(st[f"hi_{c}"])) - F.lit(float(st[f"lo_{c}"]))
                               + F.lit(1e-8))).alias(c) for c in _SCALE])


# ------------------------------------------------------------------ top-k, overlap, sets
@register("top_at_risk", f"""WITH {SCORED_SQL}
SELECT customer_id, score FROM scored ORDER BY score DESC, customer_id LIMIT 100""")
def q_top_at_risk(spark, sf_dir):
    """Top 100 customers by score (TK1): a distributed take-ordered."""
    return build_scored(spark, sf_dir).orderBy(F.col("score").desc(), KEY).limit(100) \
        .select(KEY, "score")


@register("top20_overlap", f"""WITH {SCORED_SQL},
v AS (SELECT customer_id, score, score * {_clv_sql()} AS value_at_risk FROM scored),
k AS (SELECT GREATEST(1, CAST(FLOOR(COUNT(*) * {d(0.2)}) AS BIGINT)) AS k FROM v),
a AS (SELECT customer_id FROM (SELECT customer_id, ROW_NUMBER() OVER (ORDER BY score DESC, customer_id) AS r FROM v) t, k WHERE r <= k),
b AS (SELECT customer_id FROM (SELECT customer_id, ROW_NUMBER() OVER (ORDER BY value_at_risk DESC, customer_id) AS r FROM v) t, k WHERE r <= k)
SELECT (SELECT k FROM k) AS k, COUNT(*) AS overlap, COUNT(*) / CAST((SELECT k FROM k) AS DOUBLE) AS overlap_share
FROM a WHERE customer_id IN (SELECT customer_id FROM b)""")
def q_top20_overlap(spark, sf_dir):
    """Top 20 % by churn score against top 20 % by value at risk; share of
    the first set found in the second (TK7, JN4)."""
    s = build_scored(spark, sf_dir)
    v = s.select(KEY, "score", (F.col("score") * A.clv_expr(s)).alias("value_at_risk"))
    n = v.count()
    k = max(1, int(n * 0.2))
    a = P.top_share_ids(v, KEY, "score", k)
    b = P.top_share_ids(v, KEY, "value_at_risk", k)
    ov = a.join(b, KEY, "left_semi").count()
    return spark.createDataFrame([(k, ov, ov / k)], "k long, overlap long, overlap_share double")


@register("segment_sample_union", f"""WITH {MART_SQL}, {MART_RFM_SQL}
SELECT rfm_segment, customer_id, rfm_composite_score FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY rfm_segment ORDER BY customer_id) AS rn FROM seg) t WHERE rn <= 2""")
def q_segment_sample_union(spark, sf_dir):
    """Per-segment first-two samples stacked with ``unionByName`` (ST1)."""
    seg = mart_rfm_segments(spark, sf_dir, keep=())
    from ..operators.rfm import SEGMENTS
    parts = [seg.where(F.col("rfm_segment") == s_).orderBy(KEY).limit(2)
             .select("rfm_segment", KEY, "rfm_composite_score") for s_ in SEGMENTS]
    out = parts[0]
    for p_ in parts[1:]:
        out = out.unionByName(p_)
    return out


@register("selected_intersection", f"""{EV2_SQL}
SELECT customer_id FROM sel WHERE arm = 'Prediction Only'
INTERSECT SELECT customer_id FROM sel WHERE arm = 'Integrated AI + SHAP'""")
def q_selected_intersection(spark, sf_dir):
    """Customers chosen by both the prediction-only and the integrated arm (ST2)."""
    from .policy_queries import ev2_pool
    rows = P.arm_rows(ev2_pool(spark, sf_dir), extra=["pool_pos"])
    sel = P.select_budget(rows, P.BUDGET, ["arm"], ["pool_pos"])
    a = sel.where(F.col("arm") == "Prediction Only").select(KEY)
    b = sel.where(F.col("arm") == "Integrated AI + SHAP").select(KEY)
    return a.intersect(b)


@register("vocabulary_subset", f"""WITH {MART_SQL}, {MART_DIRTY_SQL}
{' UNION ALL '.join(f"SELECT '{c}' AS column_name, COALESCE(BOOL_AND(COALESCE(lower(trim({c})) IN ({', '.join(repr(k) for k in features.BINARY_MAP)}), FALSE)), FALSE) AS is_subset FROM mart_dirty" for c in ['segment', 'nation', 'main_priority', 'priority_customer', 'balance_text'])}""")
def q_vocabulary_subset(spark, sf_dir):
    """Whether every value of a text column lies in the yes/no vocabulary (ST3)."""
    md = build_mart_dirty(spark, sf_dir)
    text = ["segment", "nation", "main_priority", "priority_customer", "balance_text"]
    keys = list(features.BINARY_MAP)
    r = md.agg(*[F.coalesce(F.bool_and(F.coalesce(F.lower(F.trim(q(c))).isin(keys), F.lit(False))),
                            F.lit(False)).alias(c) for c in text]).first()
    return spark.createDataFrame([(c, bool(r[c])) for c in text], "column_name string, is_subset boolean")


@register("distinct_labels", f"""WITH {MART_SQL}
SELECT raw_label, COUNT(*) AS n FROM (SELECT CASE WHEN churn = 1 THEN ' Churned' ELSE 'stayed ' END AS raw_label FROM mart) t
GROUP BY raw_label""")
def q_distinct_labels(spark, sf_dir):
    """Distinct raw target labels with counts (ST4)."""
    m = build_mart(spark, sf_dir)
    lab = m.select(F.when(F.col("churn") == 1, " Churned").otherwise("stayed ").alias("raw_label"))
    return lab.groupBy("raw_label").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ sampling, split
SAMPLE_SHARE = 0.5


@register("capped_sample", f"""SELECT l_orderkey, l_linenumber, h FROM (
  SELECT l_orderkey, l_linenumber, {features.sql_split_hash('(l_orderkey * 8 + l_linenumber)', 7)} AS h FROM lineitem) t
WHERE h < {int(SAMPLE_SHARE * features.HASH_MOD)}""")
def q_capped_sample(spark, sf_dir):
    """Repeatable sample of a given share of the rows by key hash (LG2, a sampling
    operator); no sort and no fixed row count."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber")
    h = features.split_hash(F.col("l_orderkey") * 8 + F.col("l_linenumber"), 7)
    return features.hash_sample(li.withColumn("h", h), "h", SAMPLE_SHARE)


@register("stratified_split", f"""WITH {MART_SQL},
sp AS (SELECT customer_id, churn, CASE WHEN ROW_NUMBER() OVER (PARTITION BY churn ORDER BY h, customer_id)
                      <= n_c - (n_c * 25 + 99) // 100 THEN 'train' ELSE 'test' END AS split
       FROM (SELECT *, {features.sql_split_hash('customer_id')} AS h,
                    COUNT(*) OVER (PARTITION BY churn) AS n_c FROM mart) t),
f AS (SELECT SUM(churn) AS pos, COUNT(*) AS n FROM mart)
SELECT customer_id, churn, split,
  CASE WHEN pos < 50 THEN 3 WHEN pos < 100 OR pos / CAST(n AS DOUBLE) < {d(0.05)} THEN 5
       WHEN n < 1000 THEN 5 WHEN n < 5000 THEN 7 ELSE 10 END AS n_folds FROM sp, f""")
def q_stratified_split(spark, sf_dir):
    """75/25 split with exact per-class proportions by key-hash rank (ML1) and
    the adaptive fold count (ML2)."""
    m = build_mart(spark, sf_dir)
    sp = features.stratified_split(m.select(KEY, "churn"), KEY, "churn")
    st = m.agg(F.sum("churn").alias("p"), F.count(F.lit(1)).alias("n")).first()
    return sp.withColumn("n_folds", F.lit(features.adaptive_folds(int(st["p"]), int(st["n"]))))


@register("cumulative_importance", f"""WITH {MART_SQL},
r AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, {i} AS position, ABS(corr(CAST({c} AS DOUBLE), CAST(churn AS DOUBLE))) AS importance FROM mart" for i, c in enumerate(MART_COLUMNS) if c in _NUM)}),
c AS (SELECT *, SUM(importance) OVER (ORDER BY importance DESC, position ROWS UNBOUNDED PRECEDING) / SUM(importance) OVER () AS cumulative_share,
             ROW_NUMBER() OVER (ORDER BY importance DESC, position) AS rank FROM r),
k AS (SELECT GREATEST(5, LEAST(COUNT(*) FILTER (WHERE cumulative_share <= {d(0.98)}) + 1, COUNT(*))) AS keep_n FROM c)
SELECT feature, importance, cumulative_share, CAST(rank AS INTEGER) AS rank, rank <= keep_n AS kept FROM c, k""")
def q_cumulative_importance(spark, sf_dir):
    """Features by |corr| with the target, cumulative share, keep until 98 %
    but at least 5 (WN4, DQ19 rule)."""
    m = build_mart(spark, sf_dir)
    imp = spark.createDataFrame(
        [(c, i) for i, c in enumerate(m.columns) if c in _NUM], "feature string, position int")
    r = m.agg(*[F.abs(F.corr(F.col(c).cast("double"), F.col("churn").cast("double"))).alias(c)
                for c in _NUM]).first()
    imp = imp.withColumn("importance", F.create_map(
        *[x for c in _NUM for x in (F.lit(c), F.lit(r[c]))])[F.col("feature")])
    w = Window.orderBy(F.col("importance").desc(), "position")        # one row per feature
    c = imp.select("feature", "importance",
                   (F.sum("importance").over(w.rowsBetween(Window.unboundedPreceding, 0))
                    / F.sum("importance").over(Window.partitionBy())).alias("cumulative_share"),
                   F.row_number().over(w).alias("rank"))
    n_le = c.where(F.col("cumulative_share") <= 0.98).count()
    keep_n = max(5, min(n_le + 1, len(_NUM)))
    return c.withColumn("kept", F.col("rank") <= keep_n)


# ------------------------------------------------------------------ run log
TEMPLATES = [
    "Input contains NaN or infinity", "could not convert string to float",
    "shape mismatch between arrays", "duplicate labels in index",
    "solver failed to converge", "unable to allocate memory",
    "column not found: tenure", "only one class present",
    "model shows overfit on holdout", "model may underfit the data",
    "CUDA device not available", "operation timed out",
    "'segment'", "bad value for parameter", "something odd happened",
]


def run_log(spark, sf_dir):
    """Failed runs from the event stream: error events with a message chosen
    by a rule on their payload (fixture B4)."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").where(F.col("event_type") == "error")
    k = F.get_json_object("props", "$.k").cast("int")
    idx = k % len(TEMPLATES)
    msg = F.element_at(F.array(*[F.lit(t) for t in TEMPLATES]), idx + 1)
    etype = F.when(idx == 12, "KeyError").when(idx == 13, "ValueError").otherwise("RuntimeError")
    return ev.select("event_id", "ts", msg.alias("message"), etype.alias("error_type"))


LOG_SQL = f"""log AS (SELECT event_id, ts,
   [{', '.join(sql_str(t) for t in TEMPLATES)}][CAST(json_extract_string(props, '$.k') AS INTEGER) % {len(TEMPLATES)} + 1] AS message,
   CASE CAST(json_extract_string(props, '$.k') AS INTEGER) % {len(TEMPLATES)} WHEN 12 THEN 'KeyError'
        WHEN 13 THEN 'ValueError' ELSE 'RuntimeError' END AS error_type
 FROM events WHERE event_type = 'error'),
cls AS (SELECT *, {runlog.sql_classify('message', 'error_type')} AS problem_type FROM log)"""


@register("log_classify", f"WITH {LOG_SQL}\nSELECT event_id, message, error_type, problem_type FROM cls")
def q_log_classify(spark, sf_dir):
    log = run_log(spark, sf_dir)
    return log.select("event_id", "message", "error_type",
                      runlog.classify(F.col("message"), F.col("error_type")).alias("problem_type"))


@register("log_report", f"""WITH {LOG_SQL}
SELECT problem_type, COUNT(*) AS n_problems, MIN(ts) AS first_seen, MAX(ts) AS last_seen,
       COUNT(*) / CAST((SELECT COUNT(*) FROM cls) AS DOUBLE) AS share FROM cls GROUP BY problem_type""")
def q_log_report(spark, sf_dir):
    log = run_log(spark, sf_dir)
    return runlog.report(log.withColumn("problem_type",
                                        runlog.classify(F.col("message"), F.col("error_type"))))
