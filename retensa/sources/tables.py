"""Table scans: Parquet test tables, CSV with an encoding fallback, fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one table; projection and filters reach the Parquet reader."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, header: bool = True,
             infer_schema: bool = False, encoding: str | None = None) -> DataFrame:
    """CSV scan with header; if the text decodes with replacement characters
    under UTF-8, read again as ISO-8859-1 (Spark never fails on bad UTF-8).

    Looking for such characters is a scan of its own, of whole files, since one bad byte may
    stand anywhere; where the encoding is known, naming it saves that scan.
    """
    opts = {"header": str(header).lower(), "inferSchema": str(infer_schema).lower(),
            "mode": "PERMISSIVE"}
    if encoding:
        return spark.read.options(encoding=encoding, **opts).csv(path)
    df = spark.read.options(**opts).csv(path)
    probe = F.lit(False)
    for c in df.columns:
        probe = probe | F.coalesce(F.col(f"`{c}`").contains("�"), F.lit(False))
    bad = df.select(F.max(probe.cast("int")).alias("bad")).first()["bad"]
    bad_header = any("�" in c for c in df.columns)
    if bad or bad_header:
        df = spark.read.options(encoding="ISO-8859-1", **opts).csv(path)
    return df


def read_any(spark: SparkSession, path: str, **options) -> DataFrame:
    """Default dataset scan by extension (Parquet or CSV, with ``read_csv``'s options)."""
    if path.lower().endswith(".csv"):
        return read_csv(spark, path, **options)
    return spark.read.parquet(path)


def content_fingerprint(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Order-free content fingerprint: row count plus xor of per-row 64-bit
    hashes, and the first 12 hex chars of a SHA-256 over those two numbers.
    One aggregate pass; no driver-side reading of rows."""
    cols = cols or df.columns
    h = F.xxhash64(*[F.col(f"`{c}`") for c in cols])
    agg = df.select(h.alias("h")).agg(F.count(F.lit(1)).alias("n_rows"),
                                      F.bit_xor("h").alias("xor_hash"))
    return agg.withColumn(
        "fingerprint",
        F.substring(F.sha2(F.concat_ws(":", F.col("n_rows").cast("string"),
                                       F.col("xor_hash").cast("string")), 256), 1, 12))
