"""Column expressions with the numeric semantics of the reference (pandas-like),
kept JVM-side so they stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepts what pandas.to_numeric accepts: optional sign, digits with optional
# fraction, exponent, and the words inf/infinity (case-insensitive), with
# surrounding blanks.  Spark alone would also accept '12d' or 'nan' (trap T6).
NUMERIC_TEXT = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"

EPS = 1e-8


def q(name: str) -> Column:
    """Column by (possibly odd) name."""
    return F.col(f"`{name}`")


def nan_to_null(c: Column) -> Column:
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def to_double(c: Column, is_string: bool) -> Column:
    """pd.to_numeric(errors='coerce'): bad text -> null, NaN -> null."""
    if is_string:
        c = F.when(c.rlike(NUMERIC_TEXT), F.trim(c).try_cast("double"))
    else:
        c = c.cast("double")
    return nan_to_null(c)


def finite_or_null(c: Column) -> Column:
    """inf / -inf / NaN -> null (reference replaces infinities by missing)."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))),
                  F.lit(None).cast("double")).otherwise(c)


def pearson(x: Column, y: Column) -> Column:
    """Pearson r over the rows where both are present, from merged centred moments
    (raw sums of squares cancel on large values with a small spread); null when
    either side is constant (trap T5: ``F.corr`` raises under ANSI)."""
    both = x.isNotNull() & y.isNotNull()
    sx, sy = F.stddev_pop(F.when(both, x)), F.stddev_pop(F.when(both, y))
    return F.when((sx > 0) & (sy > 0), F.covar_pop(x, y) / (sx * sy))


def skew_bias_corrected(n: Column, g1: Column) -> Column:
    """Adjusted Fisher-Pearson skewness (pandas .skew()) from the population
    skewness g1 that Spark's ``skewness`` returns (trap T4)."""
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def kurt_bias_corrected(n: Column, g2: Column) -> Column:
    """Sample excess kurtosis (pandas .kurt()) from Spark's population excess
    kurtosis g2."""
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6.0))


def round_half_up(c: Column, digits: int) -> Column:
    """Half-up rounding on the decimal form, identical in Spark and DuckDB."""
    return F.round(c.cast("decimal(38,12)"), digits).cast("double")


def sql_round_half_up(expr: str, digits: int) -> str:
    return f"CAST(ROUND(CAST({expr} AS DECIMAL(38,12)), {digits}) AS DOUBLE)"
