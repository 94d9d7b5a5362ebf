"""Exact linear-interpolation quantiles (pandas / numpy default, DuckDB
``quantile_cont``, Spark ``percentile``) that stay bounded in memory.

Spark's exact ``percentile`` keeps a value->count map per group and merges all of it
into one task.  Here the values of all columns become one long (column, value, count)
table, combined map-side; one distributed running sum over it gives every order
statistic of every column, at any size and number of distinct values.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import reliable_checkpoint
from .ordering import ordered_cumsum


def value_counts(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """(i, v, cnt): how often value v, which may be null, stands in column number i."""
    each = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), c.cast("double").alias("v"))
        for i, c in enumerate(cols.values())])).alias("kv")).select("kv.*")
    return each.groupBy("i", "v").agg(F.count(F.lit(1)).alias("cnt"))


@dataclass
class OrderStatistics:
    """Order statistics of one column, by rank among its n present values."""
    n: int
    missing: int
    distinct: int
    at: dict[int, float]

    def _between(self, h: float, pick) -> float:
        lo, hi, share = pick(math.floor(h)), pick(math.ceil(h)), h - math.floor(h)
        return lo if lo == hi else lo * (1.0 - share) + hi * share

    def quantile(self, p: float) -> float | None:
        return self._between((self.n - 1) * p, self.at.__getitem__) if self.n else None

    def _rank_filled(self, k: int) -> int | None:
        """Rank of the k-th value when the missing ones stand behind the lower half; None for these."""
        lower = (self.n + 1) // 2
        return k if k < lower else k - self.missing if k >= lower + self.missing else None

    def filled_quantile(self, p: float) -> float | None:
        """Quantile when the missing values are the median."""
        if not self.n:
            return None

        def pick(k: int) -> float:
            rank = self._rank_filled(k)
            return self.quantile(0.5) if rank is None else self.at[rank]

        return self._between((self.n + self.missing - 1) * p, pick)

    def needed(self, probs: list[float], filled: list[float]) -> set[int]:
        """Ranks that these quantiles (and the median) are made from."""
        out = set()
        for p in [*probs, 0.5]:
            h = (self.n - 1) * p
            out |= {math.floor(h), math.ceil(h)}
        for p in filled:
            h = (self.n + self.missing - 1) * p
            out |= {self._rank_filled(k) for k in (math.floor(h), math.ceil(h))}
        return out - {None}


def order_statistics(counts: DataFrame, names: list[str], probs: list[float],
                     filled: list[float] = ()) -> dict[str, OrderStatistics]:
    """What the quantiles ``probs`` of every column of ``value_counts``, and those of the column with
    missing values at its median, are made from: one running sum serves all."""
    present = F.col("v").isNotNull()
    totals = {r["i"]: r for r in counts.groupBy("i").agg(
        F.coalesce(F.sum(F.when(present, F.col("cnt"))), F.lit(0)).alias("n"),
        F.sum("cnt").alias("rows"), F.count_if(present).alias("distinct")).collect()}
    out: dict[str, OrderStatistics] = {}
    places, before = {}, 0
    for i, name in enumerate(names):
        n, rows, distinct = (int(totals[i][c]) for c in ("n", "rows", "distinct")) if i in totals else (0, 0, 0)
        out[name] = OrderStatistics(n, rows - n, distinct, {})
        if n:
            places |= {(i, before + k): (name, k) for k in out[name].needed(probs, filled)}
        before += n
    if not places:
        return out
    cum = ordered_cumsum(counts.where(present), ["i", "v"], {"upto": "cnt"})
    # a few rows per column and probability
    wanted = counts.sparkSession.createDataFrame(sorted(places), "wi int, place long")
    for r in cum.join(F.broadcast(wanted), (F.col("i") == F.col("wi"))
                      & (F.col("upto") - F.col("cnt") <= F.col("place"))
                      & (F.col("place") < F.col("upto"))).select("wi", "place", "v").collect():
        name, rank = places[r["wi"], r["place"]]
        out[name].at[rank] = float(r["v"])
    return out


def column_statistics(df: DataFrame, cols: dict[str, Column], probs: list[float],
                      filled: list[float] = ()) -> dict[str, OrderStatistics]:
    """``order_statistics`` of many columns from one pass over the rows."""
    if not cols:
        return {}
    return order_statistics(reliable_checkpoint(value_counts(df, cols)), list(cols), probs, filled)


def quantiles_many(df: DataFrame, cols: dict[str, Column],
                   probs: list[float]) -> dict[str, list[float | None]]:
    """Exact quantiles of many columns in one pass over the rows."""
    return {c: [s.quantile(p) for p in probs]
            for c, s in column_statistics(df, cols, probs).items()}


def exact_quantiles(df: DataFrame, col: Column | str, probs: list[float]) -> list[float | None]:
    c = F.col(f"`{col}`") if isinstance(col, str) else col
    return quantiles_many(df, {"v": c}, probs)["v"]


def exact_median(df: DataFrame, col: Column | str) -> float | None:
    return exact_quantiles(df, col, [0.5])[0]
