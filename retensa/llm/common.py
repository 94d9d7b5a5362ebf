"""Shared storage, Arrow batch mapping and fixed-size membership filters."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder name under the folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_file(spark: SparkSession, path: str) -> str:
    """Send a file of the driver to all executors; ``shipped`` finds it there by this name."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def shipped(name: str) -> str:
    from pyspark import SparkFiles
    return SparkFiles.get(name)


BATCH_ROWS = 2000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver found it.

    Arrow batches of whole texts are held by the JVM and by Python at once, so the session's
    batches are kept to ``BATCH_ROWS`` rows.
    """
    if not 0 < int(spark.conf.get(BATCH_SETTING)) <= BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))
    sc = spark.sparkContext
    if getattr(sc, "_retensa_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(), "retensa_package.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(top)))
    sc.addPyFile(archive)      # served by Spark to every executor
    sc._retensa_shipped = True


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None],
                schema: str | T.StructType, at_end: Callable[[], None] | None = None) -> DataFrame:
    """``mapInArrow`` of a function of one batch; empty batches are left out.

    At the end of a task ``at_end`` is called, and Arrow's unused memory goes back to the
    machine: the worker process stays for the next task, which may be of another stage.
    """
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch) if batch.num_rows else None
            if out is not None:
                yield out
        if at_end is not None:
            at_end()
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def least_hashed(df: DataFrame, rows: int, *columns: str) -> DataFrame:
    """The ``rows`` rows of least hash of ``columns`` (which also break ties).

    Only about four times as many rows pass the first cut on the hash, so what the sort
    gathers is bounded, however many tasks there are.
    """
    share = min(1.0, 4.0 * rows / max(1, df.count()))
    cut = -(1 << 63) + int(share * ((1 << 64) - 1))
    h = F.xxhash64(*columns)
    return df.where(h <= F.lit(min(cut, (1 << 63) - 1))).orderBy(h, *columns).limit(rows)


def same(left: Column, right: Column) -> Column:
    """Null-safe equality."""
    return left.eqNullSafe(right)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


class Membership:
    """Bit table of a fixed size over 64-bit hashes: no false negatives.

    Its size never follows the data (``bits`` is a parameter), so it may be sent to
    every task; a fuller table only lets more false positives through to the join
    behind it.
    """

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        mask = np.uint64(self.bits - 1)
        hit = self._test(hashes & mask)
        rest = np.flatnonzero(hit)
        hit[rest] = self._test((hashes[rest] >> np.uint64(32)) & mask)
        return hit

    def _test(self, place: np.ndarray) -> np.ndarray:
        return (self.words[(place >> np.uint64(6)).astype(np.int64)]
                >> (place & np.uint64(63))) & np.uint64(1) != 0


def membership(df: DataFrame, column: str, bits: int = 1 << 23) -> Membership:
    """Membership of a long column's values; at most ``bits / 64`` rows reach the driver."""
    if bits & (bits - 1) or not 64 <= bits <= 1 << 26:
        raise ValueError("bits must be a power of two from 64 to 2**26")
    mask = F.lit(bits - 1).cast("long")
    place = df.where(F.col(column).isNotNull()).select(F.explode(F.array(
        F.col(column).bitwiseAND(mask),
        F.shiftrightunsigned(F.col(column), 32).bitwiseAND(mask))).alias("place"))
    words = place.groupBy(F.shiftright("place", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("value"))
    table = np.zeros(bits // 64, np.int64)
    for r in words.collect():
        table[r["word"]] = r["value"]
    return Membership(table.view(np.uint64), bits)
