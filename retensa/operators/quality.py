"""Cleaning, profiling and leakage operators (DQ1-DQ18, FLT6).

All statistics are wide one-pass aggregates (``df.agg`` over every column at
once, partial aggregation on the map side), reshaped to a long report with
``stack``.  Correlations come from centred moments, with null for a constant column
(trap T5); mean-filled correlations follow from them in the same pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import (finite_or_null, kurt_bias_corrected, pearson, q, round_half_up,
                                 skew_bias_corrected, to_double)
from ..functions.moments import pair_correlations
from ..functions.quantiles import column_statistics, quantiles_many
from .schema import detect_id_cols, is_numeric_type, numeric_columns

# ---- fixed values (must equal the reference's) -------------------------------
TRAIN_MAX_MISSING = 0.6
REPAIR_MAX_MISSING = 0.5
NEAR_ZERO_VAR = 1e-8
FAST_LEAK_CORR = 0.75
LEAK_CORR_SMALL, LEAK_CORR_LARGE, LEAK_SMALL_ROWS = 0.87, 0.85, 1000
LEAK_MIN_NONNULL = 10
LEAK_MAX_CATEGORIES = 100
LEAK_MIN_GROUP = 5
LEAK_SEPARATION = 0.9
LEAK_MAX_DISTINCT_MEANS = 3
STRONG_CORR = 0.3
COLLINEAR_SMALL, COLLINEAR_LARGE, COLLINEAR_SMALL_COLS = 0.95, 0.90, 15
TOP_MISSING = 20
# ------------------------------------------------------------------------------


def _stack(wide: DataFrame, cols: list[str], prefixes: list[str], names: list[str],
           positions: dict[str, int] | None = None) -> DataFrame:
    """Reshape a one-row wide aggregate into one row per column."""
    parts = []
    for i, c in enumerate(cols):
        pos = positions[c] if positions else i
        parts.append(f"'{c}', {pos}, " + ", ".join(f"`{p}{i}`" for p in prefixes))
    return wide.selectExpr(
        f"stack({len(cols)}, {', '.join(parts)}) as (column_name, position, {', '.join(names)})")


def numeric_view(df: DataFrame, c: str) -> Column:
    dt = df.schema[c].dataType
    if isinstance(dt, T.BooleanType):
        return q(c).cast("double")
    return to_double(q(c), isinstance(dt, T.StringType))


def missing_counts(df: DataFrame) -> tuple[int, dict[str, int]]:
    cols = df.columns
    r = df.agg(F.count(F.lit(1)).alias("n"),
               *[F.count_if(q(c).isNull()).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    return int(r["n"]), {c: int(r[f"m{i}"]) for i, c in enumerate(cols)}


def profile_table(df: DataFrame) -> DataFrame:
    """rows, columns, missing cells, distinct dtypes, duplicates, complete rows (DQ9)."""
    cols = df.columns
    any_null = F.lit(False)
    for c in cols:
        any_null = any_null | q(c).isNull()
    r = df.agg(F.count(F.lit(1)).alias("n_rows"),
               F.sum(sum((q(c).isNull().cast("long") for c in cols), F.lit(0)))
               .alias("missing_cells"),
               F.count_if(~any_null).alias("complete_rows")).first()
    n_distinct = df.distinct().count()
    n, complete = int(r["n_rows"]), int(r["complete_rows"])
    n_types = len({f.dataType.simpleString() for f in df.schema.fields})
    row = (n, len(cols), int(r["missing_cells"] or 0), n_types, n - n_distinct, complete,
           complete * 100.0 / n if n else 0.0)
    return df.sparkSession.createDataFrame(
        [row], "n_rows long, n_columns long, missing_cells long, n_dtypes long, "
               "duplicate_rows long, complete_rows long, complete_pct double")


def profile_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """mean, median, std, missing, min, max, p25, p75, skew, kurtosis, count,
    distinct per numeric column (DQ10).  Skew/kurtosis bias-corrected (T4)."""
    exprs = []
    for i, c in enumerate(cols):
        v = numeric_view(df, c)
        n = F.count(v)
        exprs += [F.avg(v).alias(f"mean{i}"), F.stddev_samp(v).alias(f"std{i}"),
                  F.count_if(v.isNull()).alias(f"miss{i}"), F.min(v).alias(f"min{i}"),
                  F.max(v).alias(f"max{i}"), n.alias(f"cnt{i}"),
                  # rounded to 10 places: a symmetric column is 0, not +-1e-16
                  round_half_up(skew_bias_corrected(n.cast("double"), F.skewness(v)), 10)
                  .alias(f"sk{i}"),
                  round_half_up(kurt_bias_corrected(n.cast("double"), F.kurtosis(v)), 10)
                  .alias(f"ku{i}")]
    wide = df.agg(*exprs)
    # quantiles and distinct counts from the columns' value counts
    probs = {"p25_": 0.25, "med": 0.5, "p75_": 0.75}
    stats = column_statistics(df, {c: numeric_view(df, c) for c in cols}, list(probs.values()))
    wide = wide.select("*", *[F.lit(stats[c].quantile(p)).cast("double").alias(f"{name}{i}")
                              for i, c in enumerate(cols) for name, p in probs.items()],
                       *[F.lit(stats[c].distinct).cast("long").alias(f"nd{i}") for i, c in enumerate(cols)])
    return _stack(wide, cols,
                  ["mean", "med", "std", "miss", "min", "max", "p25_", "p75_", "sk", "ku",
                   "cnt", "nd"],
                  ["mean", "median", "std", "missing", "min", "max", "p25", "p75",
                   "skew", "kurtosis", "count", "n_distinct"],
                  {c: df.columns.index(c) for c in cols})


def profile_categorical(df: DataFrame, cols: list[str]) -> DataFrame:
    """distinct, most common value (ties: smallest) and its count, missing (DQ11).
    Long form: (column, value) counts with map-side partial aggregation."""
    pos = {c: df.columns.index(c) for c in cols}
    longf = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), q(c).cast("string").alias("value"))
        for c in cols])).alias("kv")).select("kv.*")
    vc = longf.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("cnt"))
    posmap = F.create_map(*[x for c, i in pos.items() for x in (F.lit(c), F.lit(i))])
    return vc.groupBy("column_name").agg(
        F.count_if(F.col("value").isNotNull()).alias("n_distinct"),
        F.min_by(F.col("value"), F.struct(-F.col("cnt"), F.col("value")))
        .alias("top_value"),
        F.max(F.when(F.col("value").isNotNull(), F.col("cnt"))).alias("top_count"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("cnt"))), F.lit(0))
        .alias("missing"),
    ).withColumn("position", posmap[F.col("column_name")])


def missing_top(df: DataFrame, k: int = TOP_MISSING) -> DataFrame:
    """Top-k columns by missing count, with share in % (DQ12)."""
    cols = df.columns
    wide = df.agg(F.count(F.lit(1)).alias("n"),
                  *[F.count_if(q(c).isNull()).alias(f"m{i}") for i, c in enumerate(cols)])
    parts = ", ".join(f"'{c}', {i}, `m{i}`, n" for i, c in enumerate(cols))
    longf = wide.selectExpr(f"stack({len(cols)}, {parts}) as (column_name, position, missing, n)")
    return (longf.select("column_name", "position", "missing",
                         (F.col("missing") * 100.0 / F.col("n")).alias("missing_pct"))
            .orderBy(F.col("missing").desc(), "position").limit(k))


def dedupe(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def sparse_constant_report(df: DataFrame, target: str | None,
                           max_missing: float = TRAIN_MAX_MISSING) -> DataFrame:
    """Per column: missing share, at most one distinct value, and the drop
    decision (DQ2, DQ3).  ``min = max`` replaces an exact distinct count."""
    cols = [c for c in df.columns if c != target]
    exprs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(cols):
        v = q(c)
        exprs += [F.count_if(v.isNull()).alias(f"m{i}"),
                  F.coalesce(F.min(v) == F.max(v), F.lit(True)).alias(f"k{i}")]
    wide = df.agg(*exprs)
    parts = ", ".join(f"'{c}', {df.columns.index(c)}, `m{i}`, `k{i}`, n"
                      for i, c in enumerate(cols))
    longf = wide.selectExpr(f"stack({len(cols)}, {parts}) as (column_name, position, missing, is_constant, n)")
    share = F.col("missing") / F.col("n")
    return longf.select(
        "column_name", "position", share.alias("missing_share"), "is_constant",
        (share > max_missing).alias("too_sparse"),
        ((share > max_missing) | F.col("is_constant")).alias("dropped"))


def near_zero_variance(df: DataFrame, cols: list[str], eps: float = NEAR_ZERO_VAR) -> list[str]:
    if not cols:
        return []
    r = df.agg(*[F.var_samp(numeric_view(df, c)).alias(f"v{i}") for i, c in enumerate(cols)]).first()
    return [c for i, c in enumerate(cols) if r[f"v{i}"] is not None and r[f"v{i}"] <= eps]


def mode_values(df: DataFrame, cols: list[str]) -> dict[str, str | None]:
    """Most common non-null value per column, ties -> smallest (trap T21)."""
    if not cols:
        return {}
    longf = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), q(c).cast("string").alias("value"))
        for c in cols])).alias("kv")).select("kv.*").where(F.col("value").isNotNull())
    vc = longf.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("cnt"))
    rows = vc.groupBy("column_name").agg(
        F.min_by("value", F.struct(-F.col("cnt"), F.col("value"))).alias("mode")).collect()
    out = {c: None for c in cols}
    out.update({r["column_name"]: r["mode"] for r in rows})
    return out


def medians(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    qs = quantiles_many(df, {c: numeric_view(df, c) for c in cols}, [0.5])
    return {c: qs[c][0] for c in cols}


def repair_table(df: DataFrame, max_missing: float = REPAIR_MAX_MISSING) -> DataFrame:
    """Whole-table repair (DQ6): inf -> null, drop columns with > 50 % missing,
    numeric median fill, text mode fill (or 'missing')."""
    numeric = [f.name for f in df.schema.fields if is_numeric_type(f.dataType)]
    fixed = df.select(*[finite_or_null(q(c).cast("double")).alias(c)
                        if c in numeric and isinstance(df.schema[c].dataType,
                                                       (T.DoubleType, T.FloatType))
                        else q(c) for c in df.columns])
    n, miss = missing_counts(fixed)
    keep = [c for c in fixed.columns if n == 0 or miss[c] / n <= max_missing]
    fixed = fixed.select(*[q(c) for c in keep])
    num = [c for c in keep if c in numeric]
    text = [c for c in keep if isinstance(fixed.schema[c].dataType, T.StringType)]
    med = medians(fixed, [c for c in num if miss[c] > 0])
    modes = mode_values(fixed, [c for c in text if miss[c] > 0])
    out = []
    for c in keep:
        if c in med and med[c] is not None:
            out.append(F.coalesce(q(c), F.lit(med[c]).cast(fixed.schema[c].dataType)).alias(c))
        elif c in modes:
            out.append(F.coalesce(q(c), F.lit(modes[c] if modes[c] is not None else "missing"))
                       .alias(c))
        else:
            out.append(q(c))
    return fixed.select(*out)


def convert_numeric_text(df: DataFrame) -> DataFrame:
    """All-or-nothing: a text column becomes double only when every non-null
    value is numeric text (DQ8)."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not text:
        return df
    from ..functions.numeric import NUMERIC_TEXT
    r = df.agg(*[F.bool_and(F.coalesce(q(c).rlike(NUMERIC_TEXT), F.lit(True))).alias(f"b{i}")
                 for i, c in enumerate(text)]).first()
    conv = {c for i, c in enumerate(text) if r[f"b{i}"]}
    return df.select(*[to_double(q(c), True).alias(c) if c in conv else q(c)
                       for c in df.columns])


def binary_remap_columns(df: DataFrame, cols: list[str], mapping: dict[str, int]) -> list[str]:
    """Columns whose every (trimmed, lower) value is a key of ``mapping`` (PRJ10)."""
    if not cols:
        return []
    keys = list(mapping)
    r = df.agg(*[F.bool_and(F.lower(F.trim(q(c).cast("string"))).isin(keys)).alias(f"b{i}")
                 for i, c in enumerate(cols)]).first()
    return [c for i, c in enumerate(cols) if r[f"b{i}"]]


def target_correlations(df: DataFrame, y: Column, cols: list[str],
                        positions: dict[str, int] | None = None) -> DataFrame:
    """Per column in one pass: r with ``y`` over complete pairs, with missing values as 0
    and as the column's mean, plus non-null count, standard deviation and whether it varies."""
    n, spread = F.count(F.lit(1)).cast("double"), F.stddev_pop(y)
    exprs = []
    for i, c in enumerate(cols):
        x = numeric_view(df, c)
        sx = F.stddev_pop(x)
        # a value at the mean adds nothing to the centred sums
        filled = F.when((sx > 0) & (spread > 0),
                        F.covar_pop(x, y) / (sx * spread) * F.sqrt(F.count(x) / n))
        exprs += [pearson(x, y).alias(f"rp{i}"),
                  pearson(F.coalesce(x, F.lit(0.0)), y).alias(f"rz{i}"), filled.alias(f"rm{i}"),
                  F.count(x).alias(f"c{i}"), F.stddev_samp(x).alias(f"d{i}"),
                  (F.min(x) < F.max(x)).alias(f"v{i}")]
    return _stack(df.agg(*exprs), cols, ["rp", "rz", "rm", "c", "d", "v"],
                  ["r_pairwise", "r_zero_filled", "r_mean_filled", "non_null", "std",
                   "varies"], positions)


def multicollinear_report(train: DataFrame, cols: list[str]) -> DataFrame:
    """Upper-triangle |r| on train; a column is dropped when its largest |r| with an
    earlier column passes the threshold (DQ18).  All pairs come from one scan."""
    best = pair_correlations(train, [numeric_view(train, c) for c in cols]).groupBy("b").agg(
        F.max(F.abs("r")).alias("max_abs_corr_prior"))
    limit = COLLINEAR_SMALL if len(cols) <= COLLINEAR_SMALL_COLS else COLLINEAR_LARGE
    names = train.sparkSession.createDataFrame(
        [(j, c, train.columns.index(c)) for j, c in enumerate(cols)],
        "b int, column_name string, position int")
    return names.join(best, "b", "left").select(
        "column_name", "position", "max_abs_corr_prior",
        F.coalesce(F.col("max_abs_corr_prior") > limit, F.lit(False)).alias("dropped"))


def leak_threshold(n_rows: int) -> float:
    return LEAK_CORR_SMALL if n_rows < LEAK_SMALL_ROWS else LEAK_CORR_LARGE


def numeric_leaks(frame: DataFrame, y: str, cols: list[str], n_rows: int) -> DataFrame:
    """Columns that follow the target: |r| with missing values at the mean (DQ15)."""
    r = target_correlations(frame, F.col(y).cast("double"), cols,
                            {c: frame.columns.index(c) for c in cols})
    r = r.where(F.col("varies") & (F.col("non_null") > LEAK_MIN_NONNULL) & (F.col("std") > 0))
    corr = F.abs("r_mean_filled")
    return r.select("column_name", "position", corr.alias("abs_corr"),
                    F.coalesce(corr > leak_threshold(n_rows), F.lit(False)).alias("is_leak"))


def categorical_leaks(frame: DataFrame, y: str, cols: list[str], n_rows: int) -> DataFrame:
    """Columns whose categories set the target apart (DQ16).

    An approximate distinct count with a margin rules out columns of many values first,
    so only possible categories are exploded and counted.
    """
    limit = min(LEAK_MAX_CATEGORIES, n_rows * 0.5)
    if not cols:
        return frame.sparkSession.createDataFrame(
            [], "column_name string, position int, n_categories long, separation double, "
                "n_means long, is_leak boolean")
    seen = frame.agg(*[F.approx_count_distinct(q(c)).alias(f"d{i}") for i, c in enumerate(cols)],
                     *[(F.min(q(c).cast("string")) < F.max(q(c).cast("string"))).alias(f"v{i}")
                       for i, c in enumerate(cols)]).first()
    few = [c for i, c in enumerate(cols) if seen[f"v{i}"] and seen[f"d{i}"] <= 1.5 * limit + 10]
    if not few:
        return categorical_leaks(frame, y, [], n_rows)
    big = F.when(F.col("count") >= LEAK_MIN_GROUP, F.col("target_mean"))
    position = F.create_map(*[F.lit(x) for c in few for x in (c, frame.columns.index(c))])
    report = category_target_means(frame, F.col(y), few).groupBy("column_name").agg(
        F.count(F.lit(1)).alias("n_categories"), (F.max(big) - F.min(big)).alias("separation"),
        F.count_distinct(big).alias("n_means")).where(F.col("n_categories") <= limit)
    return report.select(
        "column_name", position[F.col("column_name")].alias("position"), "n_categories",
        "separation", "n_means",
        F.coalesce((F.col("separation") > LEAK_SEPARATION)
                   & (F.col("n_means") <= LEAK_MAX_DISTINCT_MEANS), F.lit(False)).alias("is_leak"))


def screen_numeric(frame: DataFrame, y: str, n: int | None = None) -> DataFrame:
    """The numeric screen over all columns that are neither the target nor like an ID."""
    ids = detect_id_cols(frame.columns, target=y)
    cols = [c for c in numeric_columns(frame) if c != y and c not in ids]
    return numeric_leaks(frame, y, cols, frame.count() if n is None else n)


def flagged(report: DataFrame) -> list[str]:
    return [r["column_name"] for r in report.where("is_leak").select("column_name").collect()]


def screen_categorical(frame: DataFrame, y: str, n: int | None = None,
                       numeric: list[str] | None = None) -> DataFrame:
    """The categorical screen over what the numeric one left (``numeric``: what it flagged)."""
    n = frame.count() if n is None else n
    numeric = flagged(screen_numeric(frame, y, n)) if numeric is None else numeric
    ids = detect_id_cols(frame.columns, target=y)
    cols = [c for c in frame.columns if c != y and c not in ids and c not in numeric]
    return categorical_leaks(frame, y, cols, n)


def leaking_columns(frame: DataFrame, y: str) -> list[str]:
    """Names that either screen flags (DQ17)."""
    n = frame.count()
    numeric = flagged(screen_numeric(frame, y, n))
    return numeric + flagged(screen_categorical(frame, y, n, numeric))


def category_target_means(df: DataFrame, y: Column, cols: list[str]) -> DataFrame:
    """(column, category) -> mean target and count, missing as its own
    category; one long shuffle with partial aggregation (AG5)."""
    longf = df.select(y.cast("double").alias("_y"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), q(c).cast("string").alias("category"))
        for c in cols])).alias("kv")).select("kv.*", "_y")
    return longf.groupBy("column_name", "category").agg(
        F.avg("_y").alias("target_mean"), F.count(F.lit(1)).alias("count"))
