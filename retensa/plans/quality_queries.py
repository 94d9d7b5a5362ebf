"""Profiling, schema, cleaning, target and leakage queries with their oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numeric import finite_or_null, q
from ..operators import features, quality, schema, target
from ..session import reliable_checkpoint
from .mart import (DIRTY_COLUMNS, MART_COLUMNS, MART_DIRTY_SQL, MART_PROFILE_SQL, MART_SQL, build_mart,
                   build_mart_dirty)
from .registry import register
from .sqlgen import d
from ..functions.numeric import sql_round_half_up as rhu

MART_NUMERIC = ["customer_id", "account_balance", "tenure_days", "days_since_last_order",
                "order_count", "total_revenue", "avg_order_value", "monthly_charges",
                "usage_quantity", "complaint_ratio", "avg_discount", "urgent_share", "churn"]
MART_TEXT = ["segment", "nation", "main_priority"]
DIRTY_NUMERIC_TYPED = [c for c in DIRTY_COLUMNS
                       if c not in ("segment", "nation", "main_priority", "priority_customer",
                                    "balance_text", "leak_group")]
DIRTY_DOUBLE = ["account_balance", "total_revenue", "avg_order_value", "monthly_charges",
                "usage_quantity", "complaint_ratio", "avg_discount", "urgent_share",
                "sparse_score", "leak_stamp"]
FEATURES = ["account_balance", "tenure_days", "days_since_last_order", "order_count",
            "total_revenue", "avg_order_value", "monthly_charges", "usage_quantity",
            "complaint_ratio", "avg_discount", "urgent_share"]
W = f"WITH {MART_SQL}, {MART_DIRTY_SQL}"


def _pos(c, cols=MART_COLUMNS):
    return cols.index(c)


def _nulls_sql(cols):
    return " + ".join(f"CAST({c} IS NULL AS BIGINT)" for c in cols)


# ---------------------------------------------------------------- profiling
@register("profile_table", f"""{W}
SELECT CAST(COUNT(*) AS BIGINT) AS n_rows, CAST({len(DIRTY_COLUMNS)} AS BIGINT) AS n_columns,
  CAST(SUM({_nulls_sql(DIRTY_COLUMNS)}) AS BIGINT) AS missing_cells,
  CAST(4 AS BIGINT) AS n_dtypes,
  CAST(COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM mart_dirty) t) AS BIGINT) AS duplicate_rows,
  CAST(COUNT(*) FILTER (WHERE ({_nulls_sql(DIRTY_COLUMNS)}) = 0) AS BIGINT) AS complete_rows,
  COUNT(*) FILTER (WHERE ({_nulls_sql(DIRTY_COLUMNS)}) = 0) * {d(100.0)} / COUNT(*) AS complete_pct
FROM mart_dirty""")
def q_profile_table(spark, sf_dir):
    return quality.profile_table(build_mart_dirty(spark, sf_dir))


def _profile_numeric_sql():
    parts = []
    for c in MART_NUMERIC:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS column_name, {_pos(c)} AS position, AVG({x}) AS mean, "
            f"quantile_cont({x}, 0.5) AS median, STDDEV_SAMP({x}) AS std, "
            f"COUNT(*) - COUNT({x}) AS missing, MIN({x}) AS min, MAX({x}) AS max, "
            f"quantile_cont({x}, 0.25) AS p25, quantile_cont({x}, 0.75) AS p75, "
            f"{rhu(f'SKEWNESS({x})', 10)} AS skew, {rhu(f'KURTOSIS({x})', 10)} AS kurtosis, "
            f"COUNT({x}) AS count, "
            f"COUNT(DISTINCT {x}) AS n_distinct FROM mart")
    return f"WITH {MART_SQL}\n" + "\nUNION ALL ".join(parts)


@register("profile_numeric", _profile_numeric_sql())
def q_profile_numeric(spark, sf_dir):
    m = build_mart(spark, sf_dir)
    return quality.profile_numeric(m, schema.numeric_columns(m))


def _profile_cat_sql():
    parts = []
    for c in MART_TEXT:
        top = f"FROM mart WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY COUNT(*) DESC, {c} LIMIT 1"
        parts.append(
            f"SELECT '{c}' AS column_name, CAST(COUNT(DISTINCT {c}) AS BIGINT) AS n_distinct, "
            f"(SELECT {c} {top}) AS top_value, (SELECT COUNT(*) {top}) AS top_count, "
            f"CAST(COUNT(*) - COUNT({c}) AS BIGINT) AS missing, {_pos(c)} AS position FROM mart")
    return f"WITH {MART_SQL}\n" + "\nUNION ALL ".join(parts)


@register("profile_categorical", _profile_cat_sql())
def q_profile_categorical(spark, sf_dir):
    m = build_mart(spark, sf_dir)
    text = [f.name for f in m.schema.fields if f.dataType.simpleString() == "string"]
    return quality.profile_categorical(m, text)


def _missing_top_sql():
    parts = [f"SELECT '{c}' AS column_name, {i} AS position, COUNT(*) - COUNT({c}) AS missing, "
             f"(COUNT(*) - COUNT({c})) * {d(100.0)} / COUNT(*) AS missing_pct FROM mart_dirty"
             for i, c in enumerate(DIRTY_COLUMNS)]
    return f"{W}\nSELECT * FROM (" + "\nUNION ALL ".join(parts) + \
        ") t ORDER BY missing DESC, position LIMIT 20"


@register("missing_top20", _missing_top_sql())
def q_missing_top20(spark, sf_dir):
    return quality.missing_top(build_mart_dirty(spark, sf_dir), 20)


# ---------------------------------------------------------------- schema
def _schema_inference_sql():
    from ..functions.numeric import NUMERIC_TEXT
    parts = []
    for i, c in enumerate(DIRTY_COLUMNS):
        if c in DIRTY_NUMERIC_TYPED:
            share = f"AVG(CAST({c} IS NOT NULL AS DOUBLE))"
        else:
            share = f"AVG(CAST(COALESCE(regexp_matches({c}, '{NUMERIC_TEXT}'), FALSE) AS DOUBLE))"
        parts.append(f"SELECT '{c}' AS column_name, {i} AS position, {share} AS numeric_share "
                     f"FROM mart_dirty")
    return (f"{W}\nSELECT column_name, position, numeric_share, CASE WHEN numeric_share >= "
            f"{d(0.7)} THEN 'numeric' ELSE 'categorical' END AS inferred FROM ("
            + "\nUNION ALL ".join(parts) + ") t")


@register("schema_inference", _schema_inference_sql())
def q_schema_inference(spark, sf_dir):
    return schema.infer_types(build_mart_dirty(spark, sf_dir), threshold=0.70)


@register("role_detection", f"""WITH {MART_SQL}, {MART_PROFILE_SQL}
SELECT t.*, missing, varies FROM (VALUES
  ('tenure', 'tenure_days', 4), ('tenure', 'monthly_charges', 9), ('tenure', 'usage_quantity', 10),
  ('monetary', 'total_revenue', 7), ('monetary', 'monthly_charges', 9),
  ('usage', 'usage_quantity', 10), ('complaints', 'complaint_ratio', 11))
  t(role, column_name, position) JOIN profile USING (position)""")
def q_role_detection(spark, sf_dir):
    """Business roles by name, beside whether their columns have values that vary (PRJ16)."""
    m = build_mart(spark, sf_dir)
    return schema.with_profile(schema.roles_frame(spark, m), m)


@register("id_columns", f"""WITH {MART_SQL},
k AS (SELECT 'customer_id' AS column_name, COUNT(DISTINCT customer_id) AS n_distinct,
             COUNT(DISTINCT customer_id) = COUNT(*) AS is_key FROM mart
      UNION ALL SELECT 'churn', COUNT(DISTINCT churn), COUNT(DISTINCT churn) = COUNT(*) FROM mart)
SELECT * FROM (VALUES ('id_like', 'customer_id'),
  ('id_guess', 'customer_id'), ('target_guess', 'churn')) t(kind, column_name) JOIN k USING (column_name)""")
def q_id_columns(spark, sf_dir):
    """ID and target columns by name, and whether the rows bear an ID out (PRJ3, PRJ4)."""
    m = build_mart(spark, sf_dir)
    rows = [("id_like", c) for c in schema.detect_id_cols(m.columns, target="churn")]
    rows += [("id_guess", schema.guess_id_name(m.columns)),
             ("target_guess", schema.guess_target_name(m.columns))]
    names = spark.createDataFrame(rows, "kind string, column_name string")
    return names.join(schema.key_columns(m, sorted({c for _, c in rows if c})), "column_name")


# ---------------------------------------------------------------- cleaning
@register("dedupe_rows", f"{W}\nSELECT DISTINCT * FROM mart_dirty")
def q_dedupe_rows(spark, sf_dir):
    return quality.dedupe(build_mart_dirty(spark, sf_dir))


SPLIT_SQL = f"""md AS (SELECT DISTINCT * FROM mart_dirty),
sp AS (SELECT *, CASE WHEN ROW_NUMBER() OVER (PARTITION BY churn ORDER BY h, customer_id)
                      <= n_c - (n_c * 25 + 99) // 100 THEN 'train' ELSE 'test' END AS split
       FROM (SELECT *, {features.sql_split_hash('customer_id')} AS h,
                    COUNT(*) OVER (PARTITION BY churn) AS n_c FROM md) t)"""


def _fin(c):
    return f"CASE WHEN isfinite({c}) THEN {c} END"


@register("impute_train_only", f"""{W}, {SPLIT_SQL},
st AS (SELECT quantile_cont(account_balance, 0.5) FILTER (WHERE split = 'train') AS m_bal,
              quantile_cont(sparse_score, 0.5) FILTER (WHERE split = 'train') AS m_sp,
              quantile_cont({_fin('avg_discount')}, 0.5) FILTER (WHERE split = 'train') AS m_disc
       FROM sp),
mo AS (SELECT segment AS mode_seg FROM sp WHERE split = 'train' AND segment IS NOT NULL
       GROUP BY segment ORDER BY COUNT(*) DESC, segment LIMIT 1)
SELECT customer_id, split, COALESCE(account_balance, m_bal) AS account_balance,
       COALESCE(sparse_score, m_sp) AS sparse_score,
       COALESCE({_fin('avg_discount')}, m_disc) AS avg_discount,
       COALESCE(segment, mode_seg) AS segment
FROM sp, st, mo""")
def q_impute_train_only(spark, sf_dir):
    md = quality.dedupe(build_mart_dirty(spark, sf_dir))
    sp = features.stratified_split(md, "customer_id", "churn")
    cols = ["customer_id", "split", "account_balance", "sparse_score", "avg_discount", "segment"]
    sp = sp.select(*cols)
    fit = features.fit_imputer(sp.where(F.col("split") == "train"),
                               ["account_balance", "sparse_score", "avg_discount"], ["segment"])
    return features.apply_imputer(sp, fit)


def _repair_sql():
    sel = []
    for c in DIRTY_COLUMNS:
        if c == "sparse_score":
            continue  # > 50 % missing -> dropped
        if c in DIRTY_DOUBLE:
            sel.append(f"COALESCE({_fin(c)}, (SELECT quantile_cont({_fin(c)}, 0.5) FROM mart_dirty)) AS {c}")
        elif c == "segment":
            sel.append("COALESCE(segment, (SELECT segment FROM mart_dirty WHERE segment IS NOT NULL "
                       "GROUP BY segment ORDER BY COUNT(*) DESC, segment LIMIT 1)) AS segment")
        else:
            sel.append(c)
    return f"{W}\nSELECT {', '.join(sel)} FROM mart_dirty"


@register("repair_table", _repair_sql())
def q_repair_table(spark, sf_dir):
    return quality.repair_table(build_mart_dirty(spark, sf_dir))


def _sparse_sql():
    parts = []
    for i, c in enumerate(DIRTY_COLUMNS):
        if c == "churn":
            continue
        share = f"(COUNT(*) - COUNT({c})) / COUNT(*)"
        parts.append(
            f"SELECT '{c}' AS column_name, {i} AS position, {share} AS missing_share, "
            f"COALESCE(MIN({c}) = MAX({c}), TRUE) AS is_constant, "
            f"{share} > {d(0.6)} AS too_sparse, "
            f"({share} > {d(0.6)}) OR COALESCE(MIN({c}) = MAX({c}), TRUE) AS dropped FROM mart_dirty")
    return f"{W}\n" + "\nUNION ALL ".join(parts)


@register("drop_sparse_constant", _sparse_sql())
def q_drop_sparse_constant(spark, sf_dir):
    return quality.sparse_constant_report(build_mart_dirty(spark, sf_dir), "churn", 0.6)


_BMAP_SQL = "CASE lower(trim(priority_customer)) " + " ".join(
    f"WHEN '{k}' THEN {v}" for k, v in features.BINARY_MAP.items()) + " END"


@register("binary_remap", f"""{W}
SELECT customer_id, CAST({_BMAP_SQL} AS INTEGER) AS priority_customer FROM mart_dirty""")
def q_binary_remap(spark, sf_dir):
    md = build_mart_dirty(spark, sf_dir)
    inf = {r["column_name"]: r["inferred"] for r in
           schema.infer_types(md, exclude=["churn"]).collect()}
    text = [c for c, t in inf.items() if t == "categorical"]
    cols = quality.binary_remap_columns(md, text, features.BINARY_MAP)
    return features.binary_remap(md.select("customer_id", *cols), cols)


SEG_LEVELS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
PRI_LEVELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
MART_SPLIT_SQL = f"""sp AS (SELECT *, CASE WHEN ROW_NUMBER() OVER (PARTITION BY churn ORDER BY h, customer_id)
                      <= n_c - (n_c * 25 + 99) // 100 THEN 'train' ELSE 'test' END AS split
       FROM (SELECT *, {features.sql_split_hash('customer_id')} AS h,
                    COUNT(*) OVER (PARTITION BY churn) AS n_c FROM mart) t)"""


def _std(c):
    return f"regexp_replace(trim({c}), '\\s+', '_', 'g')"


def _onehot_sql():
    std = [v.replace(" ", "_") for v in PRI_LEVELS]
    cols = [f"CAST(COALESCE({_std('segment')} = '{v}', FALSE) AS INTEGER) AS \"segment_{v}\""
            for v in SEG_LEVELS[1:]]
    cols += [f"CAST(COALESCE({_std('main_priority')} = '{v}', FALSE) AS INTEGER) AS \"main_priority_{v}\""
             for v in std[1:]]
    return f"WITH {MART_SQL}, {MART_SPLIT_SQL}\nSELECT customer_id, split, {', '.join(cols)} FROM sp"


def mart_split(spark, sf_dir):
    return features.stratified_split(build_mart(spark, sf_dir), "customer_id", "churn")


@register("one_hot_align", _onehot_sql())
def q_one_hot_align(spark, sf_dir):
    sp = mart_split(spark, sf_dir)
    sp = sp.withColumns({c: features.standardize_text(F.col(c)) for c in ("segment", "main_priority")})
    lv = features.fit_levels(sp.where(F.col("split") == "train"), ["segment", "main_priority"])
    return features.one_hot(sp, lv, keep=["customer_id", "split"])


@register("ordinal_encode", f"""WITH {MART_SQL}
SELECT customer_id,
  CAST(DENSE_RANK() OVER (ORDER BY segment) - 1 AS INTEGER) AS segment_code,
  CAST(DENSE_RANK() OVER (ORDER BY nation) - 1 AS INTEGER) AS nation_code,
  CAST(DENSE_RANK() OVER (ORDER BY main_priority) - 1 AS INTEGER) AS main_priority_code
FROM mart""")
def q_ordinal_encode(spark, sf_dir):
    m = build_mart(spark, sf_dir)
    cols = ["segment", "nation", "main_priority"]
    return features.ordinal_encode(m, features.level_table(m, cols), cols, keep=["customer_id"])


# ---------------------------------------------------------------- target
def _labelled(spark, sf_dir, pos, neg):
    m = build_mart(spark, sf_dir)
    return m.select("customer_id", F.when(F.col("churn") == 1, pos).otherwise(neg)
                    .alias("raw_label"))


def _target_query(spark, sf_dir, pos, neg):
    return _encoded(_labelled(spark, sf_dir, pos, neg))


def _encoded(lab):
    enc, strategy = target.encode_target(lab, "raw_label", "target")
    enc = target.keep_mapped_binary(enc, "target")
    return enc.withColumn("strategy", F.lit(strategy))


def _pair_sql(pos, neg, strategy):
    return f"""WITH {MART_SQL}
SELECT customer_id, CASE WHEN churn = 1 THEN '{pos}' ELSE '{neg}' END AS raw_label,
       CAST(churn AS INTEGER) AS target, '{strategy}' AS strategy FROM mart"""


@register("target_encode_paired", _pair_sql(" YES ", "platinum", "paired_with_known_label"))
def q_target_encode_paired(spark, sf_dir):
    """One known word settles the label beside it (DQ21)."""
    return _target_query(spark, sf_dir, " YES ", "platinum")


@register("target_encode_keyword", _pair_sql("Likely churner", "Regular guest", "keyword_inference"))
def q_target_encode_keyword(spark, sf_dir):
    """A marker inside a label tells the classes apart (DQ21)."""
    return _target_query(spark, sf_dir, "Likely churner", "Regular guest")


@register("target_encode_lexicographic", f"""WITH {MART_SQL}
SELECT customer_id, raw_label, CASE WHEN raw_label = 'Group B' THEN 1 ELSE 0 END AS target,
       'lexicographic_fallback' AS strategy
FROM mart, (VALUES ('Group A'), ('Group B')) t(raw_label)""")
def q_target_encode_lexicographic(spark, sf_dir):
    """Two labels of equal size that say nothing: the first by name is 0 (DQ21)."""
    both = F.explode(F.array(F.lit("Group A"), F.lit("Group B"))).alias("raw_label")
    return _encoded(build_mart(spark, sf_dir).select("customer_id", both))


@register("target_encode_partial", f"""WITH {MART_SQL}
SELECT customer_id, CASE WHEN churn = 1 THEN 'Yes' ELSE 'No' END AS raw_label,
       CAST(churn AS INTEGER) AS target, 'partial_semantic_mapping' AS strategy
FROM mart WHERE segment IS DISTINCT FROM 'BUILDING' AND segment IS DISTINCT FROM 'MACHINERY'""")
def q_target_encode_partial(spark, sf_dir):
    """More than two labels, two of them known: rows of the others go (DQ21, FLT1)."""
    label = F.when(F.col("segment") == "BUILDING", "maybe").when(
        F.col("segment") == "MACHINERY", "unclear").when(F.col("churn") == 1, "Yes").otherwise("No")
    return _encoded(build_mart(spark, sf_dir).select("customer_id", label.alias("raw_label")))


@register("target_encode_semantic", f"""WITH {MART_SQL}
SELECT customer_id, CASE WHEN churn = 1 THEN ' Churned' ELSE 'stayed ' END AS raw_label,
       CAST(churn AS INTEGER) AS target, 'semantic_token_mapping' AS strategy FROM mart""")
def q_target_encode_semantic(spark, sf_dir):
    return _target_query(spark, sf_dir, " Churned", "stayed ")


@register("target_encode_minority", f"""WITH {MART_SQL}
SELECT customer_id, CASE WHEN churn = 1 THEN 'Group B' ELSE 'Group A' END AS raw_label,
       CAST(churn AS INTEGER) AS target, 'minority_class_as_churn' AS strategy FROM mart""")
def q_target_encode_minority(spark, sf_dir):
    return _target_query(spark, sf_dir, "Group B", "Group A")


# ---------------------------------------------------------------- correlation / leakage
def _corr_stats(df, cols, y="churn"):
    return quality.target_correlations(df, F.col(y).cast("double"), cols,
                                       {c: df.columns.index(c) for c in cols})


def _corr_ranking_sql():
    parts = [f"SELECT '{c}' AS column_name, {_pos(c)} AS position, "
             f"corr(CAST({c} AS DOUBLE), CAST(churn AS DOUBLE)) AS corr FROM mart"
             for c in MART_NUMERIC if c != "churn"]
    return (f"WITH {MART_SQL}, r AS (" + "\nUNION ALL ".join(parts) + ")\n"
            "SELECT column_name, position, corr, ABS(corr) AS abs_corr, "
            "CAST(ROW_NUMBER() OVER (ORDER BY ABS(corr) DESC NULLS LAST, position) AS INTEGER) AS corr_rank, "
            f"COALESCE(ABS(corr) > {d(0.3)}, FALSE) AS strong FROM r")


@register("corr_ranking", _corr_ranking_sql())
def q_corr_ranking(spark, sf_dir):
    m = build_mart(spark, sf_dir)
    cols = [c for c in schema.numeric_columns(m) if c != "churn"]
    r = _corr_stats(m, cols).select("column_name", "position", F.col("r_pairwise").alias("corr"))
    w = Window.orderBy(F.abs("corr").desc_nulls_last(), "position")  # one row per column
    return r.select("column_name", "position", "corr", F.abs("corr").alias("abs_corr"),
                    F.row_number().over(w).alias("corr_rank"),
                    F.coalesce(F.abs("corr") > quality.STRONG_CORR, F.lit(False)).alias("strong"))


def model_frame(spark, sf_dir):
    """Dirty mart, de-duplicated, infinities as missing: the frame the leak
    checks run on."""
    md = quality.dedupe(build_mart_dirty(spark, sf_dir))
    dbl = {f.name for f in md.schema.fields if f.dataType.simpleString() == "double"}
    return md.select(*[finite_or_null(q(c)).alias(c) if c in dbl else q(c) for c in md.columns])


def frozen_model_frame(spark, sf_dir):
    """The model frame, written once for the screens that pass over it several times."""
    return reliable_checkpoint(model_frame(spark, sf_dir))


MODEL_FRAME_SQL = "mf AS (SELECT DISTINCT " + ", ".join(
    _fin(c) + f" AS {c}" if c in DIRTY_DOUBLE else c for c in DIRTY_COLUMNS) + " FROM mart_dirty)"
LEAK_FAST_COLS = [c for c in DIRTY_COLUMNS if c not in ("customer_id", "churn", "segment", "nation",
                                                         "main_priority", "priority_customer",
                                                         "sparse_score", "leak_group")]


def _num_sql(c):
    from ..functions.numeric import NUMERIC_TEXT
    if c == "balance_text":
        return f"CASE WHEN regexp_matches({c}, '{NUMERIC_TEXT}') THEN TRY_CAST(trim({c}) AS DOUBLE) END"
    return f"CAST({c} AS DOUBLE)"


def _leak_fast_sql():
    parts = [f"SELECT '{c}' AS column_name, {DIRTY_COLUMNS.index(c)} AS position, "
             f"ABS(corr(COALESCE({_num_sql(c)}, 0), CAST(churn AS DOUBLE))) AS abs_corr, "
             f"MIN({_num_sql(c)}) < MAX({_num_sql(c)}) AS varies FROM mf" for c in LEAK_FAST_COLS]
    return (f"{W}, {MODEL_FRAME_SQL}, r AS (" + "\nUNION ALL ".join(parts) + ")\n"
            f"SELECT column_name, position, abs_corr, COALESCE(abs_corr >= {d(0.75)}, FALSE) AS is_leak "
            "FROM r WHERE varies")


@register("leak_fast", _leak_fast_sql())
def q_leak_fast(spark, sf_dir):
    mf = model_frame(spark, sf_dir)
    inf = {r["column_name"]: r["inferred"] for r in
           schema.infer_types(mf, exclude=["churn"]).collect()}
    ids = schema.detect_id_cols(mf.columns, target="churn")
    cols = [c for c in mf.columns if inf.get(c) == "numeric" and c not in ids]
    r = _corr_stats(mf, cols).where(F.col("varies"))
    return r.select("column_name", "position", F.abs("r_zero_filled").alias("abs_corr"),
                    F.coalesce(F.abs("r_zero_filled") >= quality.FAST_LEAK_CORR, F.lit(False))
                    .alias("is_leak"))


LEAK_NUM_COLS = [c for c in DIRTY_NUMERIC_TYPED if c not in ("customer_id", "churn")]


def _leak_numeric_sql():
    means = ", ".join(f"AVG({c}) AS m_{c}" for c in LEAK_NUM_COLS)
    parts = [f"SELECT '{c}' AS column_name, {DIRTY_COLUMNS.index(c)} AS position, "
             f"ABS(corr(CAST(COALESCE({c}, m_{c}) AS DOUBLE), CAST(churn AS DOUBLE))) AS abs_corr, "
             f"COUNT({c}) AS nn, STDDEV_SAMP({c}) AS sd, MIN({c}) < MAX({c}) AS varies "
             f"FROM mf, mm" for c in LEAK_NUM_COLS]
    return (f"{W}, {MODEL_FRAME_SQL}, mm AS (SELECT {means}, COUNT(*) AS n FROM mf), r AS ("
            + "\nUNION ALL ".join(parts) + ")\n"
            f"SELECT column_name, position, abs_corr, COALESCE(abs_corr > CASE WHEN (SELECT n FROM mm) < 1000 "
            f"THEN {d(0.87)} ELSE {d(0.85)} END, FALSE) AS is_leak FROM r WHERE varies AND nn > 10 AND sd > 0")


@register("leak_numeric", _leak_numeric_sql())
def q_leak_numeric(spark, sf_dir):
    return quality.screen_numeric(model_frame(spark, sf_dir), "churn")


CAT_LEAK_COLS = [c for c in DIRTY_COLUMNS if c not in ("customer_id", "churn", "leak_copy",
                                                        "leak_inverse", "leak_stamp")]


def _leak_cat_sql():
    parts = []
    for c in CAT_LEAK_COLS:
        parts.append(
            f"SELECT '{c}' AS column_name, {DIRTY_COLUMNS.index(c)} AS position, "
            f"(SELECT COUNT(DISTINCT {c}) FROM mf) AS nd, CAST(COUNT(*) AS BIGINT) AS n_categories, "
            f"MAX(m) FILTER (WHERE cnt >= 5) - MIN(m) FILTER (WHERE cnt >= 5) AS separation, "
            f"CAST(COUNT(DISTINCT m) FILTER (WHERE cnt >= 5) AS BIGINT) AS n_means "
            f"FROM (SELECT CAST({c} AS VARCHAR) AS cat, AVG(CAST(churn AS DOUBLE)) AS m, COUNT(*) AS cnt "
            f"FROM mf GROUP BY 1) g")
    return (f"{W}, {MODEL_FRAME_SQL}, r AS (" + "\nUNION ALL ".join(parts) + ")\n"
            "SELECT column_name, position, n_categories, separation, n_means, "
            f"COALESCE(separation > {d(0.9)} AND n_means <= 3, FALSE) AS is_leak FROM r "
            "WHERE nd > 1 AND n_categories <= LEAST(100, (SELECT COUNT(*) FROM mf) * 0.5)")


@register("leak_categorical", _leak_cat_sql())
def q_leak_categorical(spark, sf_dir):
    return quality.screen_categorical(frozen_model_frame(spark, sf_dir), "churn")


def _multicol_sql():
    cols = FEATURES
    parts = []
    for j, c in enumerate(cols):
        if j == 0:
            mx = "CAST(NULL AS DOUBLE)"
        else:
            mx = "GREATEST(" + ", ".join(f"ABS(corr(CAST({p} AS DOUBLE), CAST({c} AS DOUBLE)))"
                                          for p in cols[:j]) + ")"
        src = "(SELECT 1) one" if j == 0 else "sp WHERE split = 'train'"
        parts.append(f"SELECT '{c}' AS column_name, {_pos(c)} AS position, {mx} AS max_abs_corr_prior "
                     f"FROM {src}")
    thr = 0.95 if len(cols) <= 15 else 0.90
    return (f"WITH {MART_SQL}, {MART_SPLIT_SQL}, r AS (" + "\nUNION ALL ".join(parts) + ")\n"
            f"SELECT *, COALESCE(max_abs_corr_prior > {d(thr)}, FALSE) AS dropped FROM r")


@register("multicollinear_drop", _multicol_sql())
def q_multicollinear_drop(spark, sf_dir):
    sp = mart_split(spark, sf_dir)
    train = sp.where(F.col("split") == "train").drop("split")
    num = [c for c in schema.numeric_columns(train) if c not in ("churn", "customer_id")]
    from ..operators.rfm import candidate_profile
    prof = candidate_profile(train, num)
    cols = [c for c in num if prof[c]["unique_gt2"]]
    return quality.multicollinear_report(train, cols)


# ---------------------------------------------------------------- more cleaning / target
@register("near_zero_variance", f"""{W}, {MODEL_FRAME_SQL}
""" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, VAR_SAMP(CAST({c} AS DOUBLE)) AS variance, "
    f"COALESCE(VAR_SAMP(CAST({c} AS DOUBLE)) <= {d(1e-8)}, FALSE) AS low_variance FROM mf"
    for c in LEAK_NUM_COLS))
def q_near_zero_variance(spark, sf_dir):
    """Sample variance of every numeric feature; <= 1e-8 is dropped (DQ4)."""
    mf = model_frame(spark, sf_dir)
    r = mf.agg(*[F.var_samp(F.col(c).cast("double")).alias(c) for c in LEAK_NUM_COLS]).first()
    low = set(quality.near_zero_variance(mf, LEAK_NUM_COLS))
    return spark.createDataFrame([(c, r[c], c in low) for c in LEAK_NUM_COLS],
                                 "column_name string, variance double, low_variance boolean")


def _conv_sql():
    from ..functions.numeric import NUMERIC_TEXT
    text = ["segment", "nation", "main_priority", "priority_customer", "balance_text", "leak_group",
            "days_text", "cents_text"]
    return (f"{W},\nt AS (SELECT *, ' ' || tenure_days AS days_text, CASE WHEN customer_id % 3 <> 0 "
            "THEN CAST(CAST(ROUND(account_balance * 100) AS BIGINT) AS VARCHAR) || 'e0' END AS cents_text "
            "FROM mart_dirty)\n" + "\nUNION ALL ".join(
                f"SELECT '{c}' AS column_name, ok AS converted, CASE WHEN ok THEN n END AS n_values, "
                f"CASE WHEN ok THEN s END AS value_sum FROM (SELECT COALESCE(BOOL_AND(COALESCE("
                f"regexp_matches({c}, '{NUMERIC_TEXT}'), {c} IS NULL)), TRUE) AS ok, COUNT({c}) AS n, "
                f"SUM(TRY_CAST(trim({c}) AS DOUBLE)) AS s FROM t) x" for c in text))


@register("convert_numeric_text", _conv_sql())
def q_convert_numeric_text(spark, sf_dir):
    """Text columns become numbers only when every value is numeric text (DQ8): per text column
    whether it did, and the number and sum of its values as numbers."""
    cents = F.concat(F.round(F.col("account_balance") * 100).cast("long").cast("string"), F.lit("e0"))
    md = build_mart_dirty(spark, sf_dir).withColumns({
        "days_text": F.concat(F.lit(" "), F.col("tenure_days").cast("string")),
        "cents_text": F.when(F.col("customer_id") % 3 != 0, cents)})
    out = quality.convert_numeric_text(md)
    text = [f.name for f in md.schema.fields if f.dataType.simpleString() == "string"]
    done = [c for c in text if out.schema[c].dataType.simpleString() == "double"]
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(c in done).alias("converted"),
                     (F.count(c) if c in done else F.lit(None).cast("long")).alias("n_values"),
                     (F.sum(c) if c in done else F.lit(None).cast("double")).alias("value_sum"))
            for c in text]
    return out.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")


@register("clean_dataset", f"""{W}, {MODEL_FRAME_SQL}
SELECT * EXCLUDE (leak_copy, leak_inverse, leak_stamp, leak_group) FROM mf""")
def q_clean_dataset(spark, sf_dir):
    """The model frame without the columns the leak engine flags (DQ17)."""
    mf = frozen_model_frame(spark, sf_dir)
    return mf.drop(*quality.leaking_columns(mf, "churn"))


@register("validation_target", f"""WITH {MART_SQL}
SELECT customer_id, CASE WHEN lower(trim(raw_label)) IN ({', '.join(repr(x) for x in target.VALIDATION_POSITIVE)}) THEN 1
                         WHEN lower(trim(raw_label)) IN ({', '.join(repr(x) for x in target.VALIDATION_NEGATIVE)}) THEN 0 END AS y
FROM (SELECT customer_id, CASE WHEN churn = 1 THEN ' Churned' ELSE 'stayed ' END AS raw_label FROM mart) t""")
def q_validation_target(spark, sf_dir):
    """Validation-engine target coercion: numbers, else token lists, nulls to
    the mode, more than two values split at the median (DQ22)."""
    lab = _labelled(spark, sf_dir, " Churned", "stayed ")
    return target.validation_target(lab, "raw_label").select("customer_id", F.col("_y").alias("y"))


@register("validation_target_numeric", f"""WITH {MART_SQL},
r AS (SELECT customer_id, CASE WHEN customer_id % 5 <> 0 THEN churn END AS y FROM mart),
m AS (SELECT y FROM r WHERE y IS NOT NULL GROUP BY y ORDER BY COUNT(*) DESC, y LIMIT 1)
SELECT customer_id, CAST(COALESCE(r.y, m.y) AS INTEGER) AS y FROM r, m""")
def q_validation_target_numeric(spark, sf_dir):
    """Numbers as text, missing ones to the most common value (DQ22)."""
    text = F.when(F.col("customer_id") % 5 != 0, F.concat(F.lit(" "), F.col("churn"), F.lit(".0")))
    lab = build_mart(spark, sf_dir).select("customer_id", text.alias("raw_label"))
    return target.validation_target(lab, "raw_label").select("customer_id", F.col("_y").alias("y"))


@register("validation_target_many", f"""WITH {MART_SQL},
m AS (SELECT quantile_cont(CAST(order_count AS DOUBLE), 0.5) AS med FROM mart)
SELECT customer_id, CASE WHEN order_count > med THEN 1 ELSE 0 END AS y FROM mart, m""")
def q_validation_target_many(spark, sf_dir):
    """More than two values are split above the median (DQ22)."""
    lab = build_mart(spark, sf_dir).select("customer_id", F.col("order_count").alias("raw_label"))
    return target.validation_target(lab, "raw_label").select("customer_id", F.col("_y").alias("y"))
