"""Moments of all pairs of columns in one pass over the rows.

A plan with one aggregate per pair grows with the square of the columns, and splitting it
takes a scan per part.  Here every task multiplies its rows' columns as matrices, batch by
batch, and gives one row per pair; Spark adds the tasks up.  Missing values count per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ["n", "centre_a", "centre_b", "off_a", "off_b", "ss_a", "ss_b", "products"]


def pair_moments(df: DataFrame, columns: list[Column]) -> DataFrame:
    """a, b (column numbers, a < b), n (rows where both are present), means, sums of squares
    and of products about the means.

    Values are centred at one of the task's first values and tasks are merged about their common
    means, so large values with a small spread lose no digits.  A column with an
    infinite value has NaN in its pairs.
    """
    width = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, sums = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            here = ~np.isnan(x)
            if centre is None:
                centre, sums = np.zeros(width), [np.zeros((width, width)) for _ in range(6)]
            # a column gets its centre from the first batch that has a value of it
            fresh = here.any(axis=0) & (np.diag(sums[0]) == 0)
            if fresh.any():
                with np.errstate(all="ignore"):      # the value nearest to their mean
                    away = np.abs(x[:, fresh] - np.nanmean(x[:, fresh], axis=0))
                    at = np.where(np.isnan(away), np.inf, away).argmin(axis=0)
                    centre[fresh] = np.nan_to_num(x[:, fresh][at, np.arange(len(at))], posinf=0, neginf=0)
            with np.errstate(all="ignore"):
                y = np.where(here, x - centre, 0.0)
                m = here.astype(np.float64)
                # entry (i, j): over the rows where both i and j are present
                own = [m.T @ m, y.T @ m, m.T @ y, (y * y).T @ m, m.T @ (y * y), y.T @ y]
                sums = [s + o for s, o in zip(sums, own)]
        if centre is None:
            return
        a, b = np.triu_indices(width, 1)
        n, sa, sb, qa, qb, p = (s[a, b] for s in sums)
        some = n > 0
        a, b, n, sa, sb, qa, qb, p = (v[some] for v in (a, b, n, sa, sb, qa, qb, p))
        with np.errstate(all="ignore"):
            values = [n.astype(np.int64), centre[a], centre[b], sa / n, sb / n,
                      np.maximum(qa - sa * sa / n, 0), np.maximum(qb - sb * sb / n, 0),
                      p - sa * sb / n]
        yield pa.RecordBatch.from_arrays(
            [pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), *map(pa.array, values)],
            names=["a", "b", *FIELDS])

    doubles = df.select(*[c.cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    parts = doubles.mapInArrow(run, "a int, b int, n long, " + ", ".join(
        f"{c} double" for c in FIELDS[1:]))
    # tasks * pairs small rows, gathered by pair: what is merged is one row per task
    each = F.collect_list(F.struct(*FIELDS))
    gathered = parts.groupBy("a", "b").agg(each.alias("parts"))

    def total(of) -> Column:
        return F.aggregate("parts", F.lit(0.0), lambda s, p: s + of(p))

    def mean(side: str):
        """A task's mean less the first task's centre: a difference of near values is exact."""
        return lambda p: (p[f"centre_{side}"] - F.col("parts")[0][f"centre_{side}"]) + p[f"off_{side}"]

    mean_a, mean_b = mean("a"), mean("b")
    counted = gathered.withColumn("n", F.aggregate("parts", F.lit(0).cast("long"), lambda s, p: s + p.n))
    centred = counted.withColumns({"rel_a": total(lambda p: p.n * mean_a(p)) / F.col("n"),
                                   "rel_b": total(lambda p: p.n * mean_b(p)) / F.col("n")})
    return centred.select(
        "a", "b", "n", (F.col("parts")[0].centre_a + F.col("rel_a")).alias("mean_a"),
        (F.col("parts")[0].centre_b + F.col("rel_b")).alias("mean_b"),
        total(lambda p: p.ss_a + p.n * (mean_a(p) - F.col("rel_a")) ** 2).alias("ss_a"),
        total(lambda p: p.ss_b + p.n * (mean_b(p) - F.col("rel_b")) ** 2).alias("ss_b"),
        total(lambda p: p.products + p.n * (mean_a(p) - F.col("rel_a"))
              * (mean_b(p) - F.col("rel_b"))).alias("products"))


#: a sum of squares this much below the square of the mean is rounding, not spread
ROUNDING = 1e-28


def pair_correlations(df: DataFrame, columns: list[Column]) -> DataFrame:
    """a, b, n and r of every pair; r is null where either column is constant."""
    m = pair_moments(df, columns)

    def varies(ss: str, mean: str) -> Column:
        return F.col(ss) > F.col("n") * F.col(mean) ** 2 * ROUNDING

    r = F.when(varies("ss_a", "mean_a") & varies("ss_b", "mean_b"),
               F.col("products") / (F.sqrt("ss_a") * F.sqrt("ss_b")))
    known = r.isNotNull() & ~F.isnan(r)
    return m.select("a", "b", "n", F.when(
        known, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("r"))
