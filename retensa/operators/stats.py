"""Rank statistics as aggregates (SS1-SS5, WN3).

Average-tie ranks come from per-value counts and a distributed running count
(no global sort of all rows into one task).  The tests join those counts, not the rows,
to the ranks, so a value that most rows share stays one row; p-values use a rational
approximation of the normal tail.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import round_half_up
from ..functions.ordering import ordered_cumsum

# ---- fixed values (must equal the reference's) -------------------------------
COHEN_LARGE, COHEN_MEDIUM, COHEN_SMALL = 0.8, 0.5, 0.2
WILCOXON_MIN_PAIRS = 10
MANNWHITNEY_MIN = 3
NORMALITY_MIN = 8
JB_CRITICAL_95 = 5.991464547107979   # chi-square(2) 95 % quantile
# ------------------------------------------------------------------------------


SIGNIFICANT = 0.05
# rational approximation of the normal tail (error below 1e-7), fixed values
TAIL_SCALE = 0.2316419
TAIL_TERMS = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def two_sided_p(z: Column) -> Column:
    """Two-sided tail probability of a standard normal value."""
    x = F.abs(z)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(TAIL_SCALE) * x)
    poly = F.lit(0.0)
    for c in reversed(TAIL_TERMS):
        poly = (poly + F.lit(c)) * t
    return F.lit(2.0) * F.exp(-x * x / 2.0) / F.lit(math.sqrt(2 * math.pi)) * poly


def sql_two_sided_p(z: str) -> str:
    t = f"(1e0 / (1e0 + {TAIL_SCALE!r}e0 * abs({z})))"
    poly = "0e0"
    for c in reversed(TAIL_TERMS):
        poly = f"(({poly} + {c!r}e0) * {t})"
    return f"(2e0 * exp(-({z}) * ({z}) / 2e0) / {math.sqrt(2 * math.pi)!r}e0 * {poly})"


def value_ranks(counts: DataFrame, value: str, n: str, descending: bool = False,
                groups: tuple[str, ...] = ()) -> DataFrame:
    """(groups, value, _rank, _ties) of a table of values and how often they occur: average-tie
    rank (1 = smallest, or largest if descending) and the number of equal rows.

    With ``groups`` the ranks begin anew in each: one running count over (groups, value) serves
    all of them, however many or uneven they are, less the count before each group.
    """
    per = counts.groupBy(*groups, value).agg(F.sum(n).alias("_ties"))
    cum = ordered_cumsum(per, [*groups, value], {"_cum": "_ties"},
                         descending=[False] * len(groups) + [descending])
    if groups:
        before = cum.groupBy(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)]).agg(
            F.min(F.col("_cum") - F.col("_ties")).alias("_before"))
        at = all_equal([(F.col(g), F.col(f"_g{i}")) for i, g in enumerate(groups)])
        cum = cum.join(before, at).withColumn("_cum", F.col("_cum") - F.col("_before"))
    return cum.select(*groups, value, "_ties",
                      (F.col("_cum") - (F.col("_ties") - 1) / 2.0).alias("_rank"))


def all_equal(pairs: list[tuple[Column, Column]]) -> Column:
    """Whether both sides of every pair are equal, nulls included."""
    out = F.lit(True)
    for left, right in pairs:
        out = out & left.eqNullSafe(right)
    return out


def average_rank(df: DataFrame, value: str, out: str, descending: bool = False) -> DataFrame:
    """Average-tie rank of ``value`` for every row."""
    counts = df.groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ranks = value_ranks(counts, "_v", "_n", descending).select("_v", F.col("_rank").alias(out))
    return df.join(ranks, df[value].eqNullSafe(ranks["_v"]), "left").drop("_v")


def _weighted_corr(x: str, y: str, w: str) -> Column:
    """Correlation of rows that stand for ``w`` equal ones, from centred sums."""
    mx, my, n = f"_m{x}", f"_m{y}", F.sum(w)
    dx, dy = F.col(x) - F.col(mx), F.col(y) - F.col(my)
    sx, sy = F.sum(dx * dx * F.col(w)), F.sum(dy * dy * F.col(w))
    return F.when((sx > 0) & (sy > 0) & (n > 0), F.sum(dx * dy * F.col(w)) / F.sqrt(sx * sy))


def spearman(df: DataFrame, a: str, b: str, descending: bool = True) -> DataFrame:
    """Pearson correlation of the average-tie ranks (SS1).

    Rows are first counted by their pair of values, so a value that many rows share is one
    row in the joins with the ranks.
    """
    pairs = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("w"))
    for c in ("a", "b"):
        ranks = value_ranks(pairs, c, "w", descending).select(
            F.col(c).alias("_v"), F.col("_rank").alias(f"r{c}"))
        pairs = pairs.join(ranks, F.col(c).eqNullSafe(F.col("_v")), "left").drop("_v")
    # ranks have a known mean: (n + 1) / 2
    n = pairs.agg(F.sum("w")).first()[0] or 0
    half = F.lit((n + 1) / 2.0)
    ranked = pairs.withColumns({"_mra": half, "_mrb": half})
    return ranked.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("n"),
                      _weighted_corr("ra", "rb", "w").alias("rho"))


def signed_ranks(df: DataFrame, diff: str, groups: tuple[str, ...] = ()) -> DataFrame:
    """Per group (or for all rows): n non-zero differences, w_plus, w_minus, statistic =
    min(W+, W-), and the normal z with the tie term.  Groups without any have no row."""
    by_value = df.where(F.col(diff) != 0).groupBy(
        *groups, F.abs(F.col(diff)).alias("size"), (F.col(diff) > 0).alias("up")).agg(
        F.count(F.lit(1)).alias("w"))
    ranks = value_ranks(by_value, "size", "w", groups=groups)
    # both directions of one size share its rank, so they are one row of the join's left side
    sides = by_value.groupBy(*groups, "size").agg(
        F.sum(F.when(F.col("up"), F.col("w")).otherwise(0)).alias("plus"), F.sum("w").alias("w"))
    right = ranks.select(*[F.col(g).alias(f"_r{i}") for i, g in enumerate(groups)],
                         F.col("size").alias("_size"), "_rank", "_ties")
    on = all_equal([(F.col("size"), F.col("_size")),
                    *[(F.col(g), F.col(f"_r{i}")) for i, g in enumerate(groups)]])
    plus = F.col("_rank") * F.col("plus")
    s = sides.join(right, on).groupBy(*groups).agg(
        F.coalesce(F.sum("w"), F.lit(0)).alias("n"), F.sum(plus).alias("w_plus"),
        F.sum(F.col("_rank") * F.col("w") - plus).alias("w_minus"),
        F.sum(F.pow(F.col("_ties"), 3) - F.col("_ties")).alias("ties"))
    n = F.col("n").cast("double")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - F.col("ties") / 48.0)
    stat = F.least("w_plus", "w_minus")
    z = F.when(sd > 0, (stat - n * (n + 1) / 4.0) / sd)
    return s.select(*groups, "n", "w_plus", "w_minus", stat.alias("statistic"), z.alias("z"))


def wilcoxon(df: DataFrame, diff: str, groups: tuple[str, ...] = ()) -> DataFrame:
    """Signed-rank test on non-zero differences, normal approximation (SS2); ``tested`` from
    ``WILCOXON_MIN_PAIRS`` pairs."""
    s = signed_ranks(df, diff, groups)
    tested, p = F.col("n") >= WILCOXON_MIN_PAIRS, two_sided_p(F.col("z"))
    return s.select(*groups, "n", "w_plus", "w_minus", "statistic", "z",
                    round_half_up(p, 6).alias("p_value"), tested.alias("tested"),
                    F.coalesce(tested & (p < SIGNIFICANT), F.lit(False)).alias("significant"))


def mann_whitney(df: DataFrame, value: str, group: str) -> DataFrame:
    """Each group against all other rows: U of the group, tie-corrected
    normal z with continuity correction (SS4)."""
    counts = df.groupBy(F.col(group), F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("w"))
    ranks = value_ranks(counts, "v", "w").withColumnRenamed("v", "_v")
    tie, n_all = ranks.agg(F.sum(F.pow(F.col("_ties"), 3) - F.col("_ties")), F.sum("_ties")).first()
    tie, n_all = float(tie or 0), float(n_all or 0)
    g = counts.join(ranks, F.col("v").eqNullSafe(F.col("_v"))).groupBy(group).agg(
        F.sum("w").alias("n_segment"), F.sum(F.col("_rank") * F.col("w")).alias("r1"))
    n1 = F.col("n_segment").cast("double")
    n2 = F.lit(n_all) - n1
    u = F.col("r1") - n1 * (n1 + 1) / 2.0
    sigma = F.sqrt(n1 * n2 / 12.0 * (F.lit(n_all + 1) - F.lit(tie) / F.lit(max(1.0, n_all * (n_all - 1)))))
    z = F.when(sigma > 0, (F.abs(u - n1 * n2 / 2.0) - 0.5) / sigma)
    tested = (n1 >= MANNWHITNEY_MIN) & (n2 >= MANNWHITNEY_MIN)
    return g.select(group, "n_segment", n2.cast("long").alias("n_rest"), u.alias("u_statistic"),
                    z.alias("z"), round_half_up(two_sided_p(z), 6).alias("p_value"),
                    tested.alias("tested"),
                    F.coalesce(tested & (two_sided_p(z) < SIGNIFICANT), F.lit(False))
                    .alias("significant"))


def cohen_label(d: Column) -> Column:
    a = F.abs(d)
    return (F.when(a >= COHEN_LARGE, "Large").when(a >= COHEN_MEDIUM, "Medium")
            .when(a >= COHEN_SMALL, "Small").otherwise("Negligible"))


def cohens_d_pooled(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mean of (b - a) over sqrt((var_a + var_b) / 2) (SS3, EV1 form)."""
    s = df.agg(F.avg(F.col(b) - F.col(a)).alias("mean_diff"),
               F.sqrt((F.var_samp(a) + F.var_samp(b)) / 2.0).alias("pooled_std"))
    d = F.when(F.col("pooled_std") > 0, F.col("mean_diff") / F.col("pooled_std")).otherwise(0.0)
    return s.select("mean_diff", "pooled_std", d.alias("cohens_d"), cohen_label(d).alias("magnitude"))


def jarque_bera(df: DataFrame, value: str) -> DataFrame:
    """Normality of non-zero values from population skewness and excess
    kurtosis in one aggregate (SS5, re-aimed from Shapiro-Wilk)."""
    nz = df.where(F.col(value) != 0)
    s = nz.agg(F.count(F.lit(1)).alias("n"), F.skewness(value).alias("skew"),
               F.kurtosis(value).alias("excess_kurtosis"))
    jb = F.col("n") / 6.0 * (F.pow("skew", 2) + F.pow("excess_kurtosis", 2) / 4.0)
    return s.select("n", "skew", "excess_kurtosis", jb.alias("jb"),
                    (jb < JB_CRITICAL_95).alias("is_normal"),
                    (F.col("n") >= NORMALITY_MIN).alias("tested"))
