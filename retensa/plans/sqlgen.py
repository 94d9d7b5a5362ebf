"""Small generators of DuckDB SQL used by the oracle strings.

DuckDB reads a literal such as ``0.4`` as DECIMAL; the Spark side multiplies
doubles, so every fractional constant is written as an explicit DOUBLE.
"""

from __future__ import annotations


def d(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def quintile_ctes(name: str, table: str, expr: str) -> str:
    """CTEs ``{name}_s`` with med, e (6 quantile edges of the median-filled
    value), distinct flag, and equal-width bins b1..b5 (pandas cut)."""
    return f"""
{name}_f AS (SELECT CAST({expr} AS DOUBLE) AS v0 FROM {table}),
{name}_m AS (SELECT quantile_cont(v0, 0.5) AS med FROM {name}_f),
{name}_q AS (SELECT quantile_cont(COALESCE(v0, med), [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e, med
             FROM {name}_f, {name}_m GROUP BY med),
{name}_s AS (SELECT med, e,
   (e[1] < e[2] AND e[2] < e[3] AND e[3] < e[4] AND e[4] < e[5] AND e[5] < e[6]) AS dist,
   (e[6] - e[1]) / 5 AS step, e[1] AS mn, e[6] AS mx FROM {name}_q)"""


def quintile_score(name: str, expr: str, reverse: bool) -> str:
    """Score expression; needs ``{name}_s`` joined in (one row)."""
    v = f"COALESCE(CAST({expr} AS DOUBLE), {name}_s.med)"
    s = f"{name}_s"
    q = (f"CASE WHEN {v} <= {s}.e[2] THEN 1 WHEN {v} <= {s}.e[3] THEN 2 "
         f"WHEN {v} <= {s}.e[4] THEN 3 WHEN {v} <= {s}.e[5] THEN 4 "
         f"WHEN {v} <= {s}.e[6] THEN 5 END")
    c = (f"CASE WHEN {v} <= 1 * {s}.step + {s}.mn THEN 1 "
         f"WHEN {v} <= 2 * {s}.step + {s}.mn THEN 2 "
         f"WHEN {v} <= 3 * {s}.step + {s}.mn THEN 3 "
         f"WHEN {v} <= 4 * {s}.step + {s}.mn THEN 4 WHEN {v} <= {s}.mx THEN 5 END")
    raw = f"(CASE WHEN {s}.dist THEN {q} ELSE {c} END)"
    if reverse:
        raw = f"(6 - {raw})"
    return f"CAST(COALESCE({raw}, 3) AS INTEGER)"


def sql_str(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"
