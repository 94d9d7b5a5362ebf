"""Embedding whitening: leading components of the vectors' covariance, by FEAST.

Vectors go on an integer lattice, ``floor(scale * entry)``; the fit list is every distinct
lattice vector once.  Its sums and its matrix of products are integer sums that Spark adds
up, so they are exact and do not depend on the partitioning; only the covariance, a square
of the dimension, reaches the driver, where ``feast.leading`` finds its components.

Defined cases: rows whose vector is null or holds a null or non-finite entry are dropped; so
are rows whose vector has not the dimension, which is the length most distinct vectors have (the greater one
of equals; an empty vector has none).  Lattice values end at the limits of 64 bits.  A
null id is an id like any other; repeated rows are returned as often as they come and count
once in the fit.  A component without variance (one vector, or fewer independent ones than
components) has null in ``whitened``; ``explained`` is null where nothing varies at all, and
``identity_error`` is taken over the components that vary.  Without rows there is no result.
"""

from __future__ import annotations

import decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, ship_package, stored
from .feast import EPS, leading

LONG_MAX, LONG_MIN = (1 << 63) - 1, -(1 << 63)
LIMB = 60
LIMBS = "hi decimal(38,0), lo decimal(38,0)"
#: integers up to here are exact as doubles
EXACT = 1 << 53


def to_lattice(values: np.ndarray, scale: float) -> np.ndarray:
    f = np.floor(scale * values.astype(np.float64))
    out = np.where(np.abs(f) < 2.0 ** 63, f, 0).astype(np.int64)
    out[f >= 2.0 ** 63] = LONG_MAX
    out[f < -(2.0 ** 63)] = LONG_MIN
    return out


def lattice(df: DataFrame, id_column: str, vector: str, scale: float) -> DataFrame:
    """id and x (array of long) of the rows whose vector is whole and finite."""
    kind = df.schema[id_column].dataType.simpleString()

    def run(batch):
        ids, column = batch.column(0), batch.column(1)
        offsets = column.offsets.to_numpy().astype(np.int64)
        values = column.values
        bad = values.is_null().to_numpy(zero_copy_only=False)
        entries = values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
        bad |= ~np.isfinite(entries)
        before = np.concatenate(([0], np.cumsum(bad)))
        keep = (before[offsets[1:]] == before[offsets[:-1]]) & column.is_valid().to_numpy(
            zero_copy_only=False)
        x = to_lattice(np.where(bad, 0, entries), scale)
        whole = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(x))
        return pa.RecordBatch.from_arrays([ids, whole], names=["id", "x"]).filter(pa.array(keep))

    return map_batches(df.select(F.col(id_column).alias("id"), F.col(vector).cast("array<double>")),
                       run, f"id {kind}, x array<long>")


def matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dimension)


def _limbs(numbers: list[int]) -> list[pa.Array]:
    """Whole numbers of any size as two decimal columns, so that sums of them stay exact."""
    return [pa.array([decimal.Decimal(v) for v in part], pa.decimal128(38, 0))
            for part in ([n >> LIMB for n in numbers], [n & ((1 << LIMB) - 1) for n in numbers])]


def exact_products(z: np.ndarray) -> np.ndarray:
    """``z.T @ z`` of whole numbers, exact."""
    largest = max(abs(int(z.max())), abs(int(z.min()))) if z.size else 0
    if largest * largest * len(z) < EXACT:
        f = z.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    whole = z.astype(object)
    return whole.T @ whole


def shifted(x: np.ndarray, by: list[int]) -> np.ndarray:
    """``x - by`` without overflow."""
    if x.size and max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, by)) > LONG_MAX:
        return x.astype(object) - np.array(by, object)
    return x - np.array(by, np.int64)


def _summed(fit: DataFrame, dimension: int, of, schema: str, key: list[str]) -> list:
    """Exact sums over the fit list: ``of`` turns a batch's matrix into an object array, a
    task adds its batches up and Spark the tasks; one row per entry reaches the driver."""
    ship_package(fit.sparkSession)

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                own = of(matrix(batch.column(0), dimension))
                total = own if total is None else total + own
        if total is not None:
            at = np.nonzero(np.triu(np.ones((dimension, dimension)))) if total.ndim == 2 else (
                np.arange(len(total)),)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(i.astype(np.int32)) for i in at), *_limbs([int(v) for v in total[at]])],
                names=[*key, "hi", "lo"])

    parts = fit.mapInArrow(run, f"{schema}, {LIMBS}")
    return parts.groupBy(*key).agg(F.sum("hi").alias("hi"), F.sum("lo").alias("lo")).collect()


def _value(row) -> int:
    return (int(row["hi"]) << LIMB) + int(row["lo"])


class Fit:
    """n, exact sums, covariance, eigenvalues and components of a fit list."""

    def __init__(self, fit: DataFrame, n: int, dimension: int, components: int):
        self.n, self.dimension = n, dimension
        sums = _summed(fit, dimension, lambda x: x.astype(object).sum(axis=0), "i int", ["i"])
        self.sums = [0] * dimension
        for r in sums:
            self.sums[r["i"]] = _value(r)
        # centred at the nearest whole number first; what is left of the mean is below one half
        middle = [(2 * s + n) // (2 * n) for s in self.sums]
        rest = [s - n * m for s, m in zip(self.sums, middle)]
        products = _summed(fit, dimension, lambda x: exact_products(shifted(x, middle)),
                           "i int, j int", ["i", "j"])
        self.covariance = np.zeros((dimension, dimension))
        for r in products:
            i, j = r["i"], r["j"]
            exact = n * _value(r) - rest[i] * rest[j]
            self.covariance[i, j] = self.covariance[j, i] = exact / (n * n)
        self.trace = float(self.covariance.trace())
        self.values, self.vectors = leading(self.covariance, components)
        self.varies = self.values > 4 * dimension * EPS * self.trace

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """``n * x - sums``, exact (Python integers where 64 bits might not do)."""
        bound = max(abs(int(x.max())), abs(int(x.min()))) * self.n + max(map(abs, self.sums))
        if bound * bound * self.dimension > LONG_MAX:
            return x.astype(object) * self.n - np.array(self.sums, object)
        return x * np.int64(self.n) - np.array(self.sums, np.int64)

    def whiten(self, deviations: np.ndarray) -> np.ndarray:
        """Projections over square roots; columns of components that do not vary are NaN."""
        scale = np.full(len(self.values), np.nan)
        scale[self.varies] = self.values[self.varies] ** -0.5
        return (deviations / self.n).astype(np.float64) @ self.vectors * scale


def fit_components(vectors: DataFrame, components: int) -> tuple[Fit | None, DataFrame]:
    """The fit of all distinct vectors, and the stored list of them."""
    distinct = stored(vectors.select("x").distinct(), "fit-list")
    common = distinct.where(F.size("x") > 0).groupBy(F.size("x").alias("d")).count().orderBy(
        F.desc("count"), F.desc("d")).limit(1).collect()
    if not common:
        return None, distinct
    dimension, n = common[0]["d"], common[0]["count"]
    distinct = distinct.where(F.size("x") == dimension)
    return Fit(distinct, n, dimension, components), distinct


def identity_error(fit: Fit, distinct: DataFrame) -> float | None:
    """Largest absolute entry of (covariance of the whitened fit list - identity)."""
    use = np.flatnonzero(fit.varies)
    if not len(use):
        return None
    ship_package(distinct.sparkSession)

    def run(batches):
        count, mean, spread = 0, 0.0, 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            w = fit.whiten(fit.deviations(matrix(batch.column(0), fit.dimension)))[:, use]
            own = w.mean(axis=0)
            gap, share = own - mean, len(w) / (count + len(w))
            spread = spread + (w - own).T @ (w - own) + np.outer(gap, gap) * (count * share)
            mean, count = mean + gap * share, count + len(w)
        if count:
            i, j = np.triu_indices(len(use))
            yield pa.RecordBatch.from_arrays(
                [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
                 pa.array(np.full(len(i), count, np.int64)), pa.array(mean[i]), pa.array(mean[j]),
                 pa.array(spread[i, j])], names=["i", "j", "n", "a", "b", "spread"])

    parts = distinct.mapInArrow(run, "i int, j int, n long, a double, b double, spread double")
    # the means of the tasks are themselves near zero, so their products lose no digits
    n, a, b = F.col("n"), F.col("a"), F.col("b")
    entry = (F.sum("spread") + F.sum(n * a * b) - F.sum(n * a) * F.sum(n * b) / F.sum("n")) / F.sum("n")
    off = parts.groupBy("i", "j").agg(
        F.abs(entry - (F.col("i") == F.col("j")).cast("double")).alias("off"))
    return off.agg(F.max("off")).first()[0]


def _decimals(squares: np.ndarray) -> pa.Array:
    if squares.dtype != object:
        return pa.array(squares).cast(pa.decimal128(38, 0))
    top = 10 ** 38
    return pa.array([decimal.Decimal(int(v)) if v < top else None for v in squares],
                    pa.decimal128(38, 0))


def whiten(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding",
           components: int = 4, scale: float = 256.0) -> DataFrame:
    """Every remaining row's first components, one row for each: the id, component, n,
    deviation (decimal; null beyond 38 digits), whitened, explained and identity_error."""
    kind = df.schema[id_column].dataType.simpleString()
    schema = (f"{id_column} {kind}, component int, n long, deviation decimal(38,0), "
              "whitened double, explained double, identity_error double")
    vectors = lattice(df, id_column, vector, scale)
    fit, distinct = fit_components(vectors, components)
    if fit is None:
        return df.sparkSession.createDataFrame([], schema)
    error = identity_error(fit, distinct)
    k = len(fit.values)
    explained = fit.values / fit.trace if fit.trace > 0 else np.full(k, np.nan)

    def run(batch):
        rows = batch.num_rows
        off = fit.deviations(matrix(batch.column(1), fit.dimension))
        w = fit.whiten(off).reshape(-1)
        each = pa.array(np.repeat(np.arange(rows), k))
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
             pa.array(np.full(rows * k, fit.n, np.int64)),
             _decimals((off * off).sum(axis=1)).take(each),
             pa.array(w, from_pandas=True), pa.array(np.tile(explained, rows), from_pandas=True),
             pa.array([error] * (rows * k), pa.float64())],
            names=[id_column, "component", "n", "deviation", "whitened", "explained",
                   "identity_error"])

    return map_batches(vectors.where(F.size("x") == fit.dimension), run, schema)
