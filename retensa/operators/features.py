"""Split, train-only imputation and encoders (ML1, ML2, DQ5, DQ7, PRJ10-PRJ14).

The split is repeatable and engine-independent: an integer hash of the key
orders rows inside each class and exact per-class proportions are taken by
rank.  The rank is a distributed running count (``ordered_cumsum``), so a
class holding most rows is never sorted inside one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import finite_or_null, q
from ..functions.ordering import key_number, ordered_cumsum
from .quality import medians, mode_values, numeric_view

# ---- fixed values (must equal the reference's) -------------------------------
SPLIT_SEED = 123
TEST_PCT = 25
BOOL_MAP = {"yes": 1, "y": 1, "true": 1, "t": 1, "1": 1,
            "no": 0, "n": 0, "false": 0, "f": 0, "0": 0}
GENDER_MAP = {"male": 1, "m": 1, "female": 0, "fem": 0}
BINARY_MAP = {**BOOL_MAP, **GENDER_MAP}
UNKNOWN = "Unknown"
# ------------------------------------------------------------------------------

HASH_MOD = 2147483647     # Lehmer / MINSTD generator: fits 64-bit math everywhere
HASH_MULT = 48271

def drop_rfm(df: DataFrame) -> DataFrame:
    """The frame without RFM features (DQ20)."""
    return df.drop(*[c for c in df.columns if c.lower().startswith("rfm_")])


def check_no_rfm(names: list[str]) -> None:
    """Refuse assembled training inputs that hold an RFM feature (DQ20)."""
    found = [n for n in names if n.lower().startswith("rfm_")]
    if found:
        raise ValueError(f"RFM features among the training inputs: {found}")


def hash_sample(df: DataFrame, hashed: str, share: float) -> DataFrame:
    """Rows whose key hash lies in the first ``share`` of its range."""
    if not 0 <= share <= 1:
        raise ValueError("share must lie between 0 and 1")
    return df.where(F.col(hashed) < F.lit(int(share * HASH_MOD)))


def split_hash(key: Column, seed: int = SPLIT_SEED) -> Column:
    return (((key + F.lit(seed)) % F.lit(HASH_MOD)) * F.lit(HASH_MULT)) % F.lit(HASH_MOD)


def sql_split_hash(key: str, seed: int = SPLIT_SEED) -> str:
    return f"((({key} + {seed}) % {HASH_MOD}) * {HASH_MULT}) % {HASH_MOD}"


def stratified_split(df: DataFrame, key: str, label: str, test_pct: int = TEST_PCT,
                     seed: int = SPLIT_SEED, out: str = "split") -> DataFrame:
    """Per class: the first n - ceil(n * test_pct / 100) rows by (hash, key) are
    'train', the rest 'test'.  Keys may be numbers or text.

    Only (label, hash, key) are ranked; the classes' counts and offsets stay a table, so
    any number of classes will do."""
    h = df.select(q(label), split_hash(key_number(df, key), seed).alias("_h"), q(key),
                  F.lit(1).cast("long").alias("_one"))
    ranked = ordered_cumsum(h, [label, "_h", key], {"_r": "_one"})
    classes = h.groupBy(q(label).alias("_label")).agg(F.sum("_one").alias("_n"))
    upto = ordered_cumsum(classes, ["_label"], {"_upto": "_n"})
    n_train = F.col("_n") - F.floor((F.col("_n") * test_pct + 99) / 100)
    is_train = F.col("_r") - (F.col("_upto") - F.col("_n")) <= n_train
    part = ranked.join(upto, q(label).eqNullSafe(F.col("_label"))).select(
        q(key).alias("_key"), F.when(is_train, "train").otherwise("test").alias(out))
    return df.join(part.dropDuplicates(["_key"]), q(key).eqNullSafe(F.col("_key"))).drop("_key")


def adaptive_folds(n_pos: int, n: int) -> int:
    """ML2: fold count from positives, positive rate and rows."""
    rate = n_pos / n if n > 0 else 0.5
    if n_pos < 50:
        return 3
    if n_pos < 100 or rate < 0.05:
        return 5
    if n < 1000:
        return 5
    if n < 5000:
        return 7
    return 10


def fit_imputer(train: DataFrame, num_cols: list[str], cat_cols: list[str]) -> dict:
    """Train-only statistics: numeric median (after inf -> null), category mode."""
    fin = train.select(*[finite_or_null(numeric_view(train, c)).alias(c) for c in num_cols],
                       *[q(c) for c in cat_cols])
    med = medians(fin, num_cols)
    modes = mode_values(fin, cat_cols)
    return {"median": med, "mode": {c: (m if m is not None else UNKNOWN) for c, m in modes.items()}}


def apply_imputer(df: DataFrame, fit: dict) -> DataFrame:
    out = []
    for c in df.columns:
        if c in fit["median"]:
            v = finite_or_null(numeric_view(df, c))
            med = fit["median"][c]
            out.append((F.coalesce(v, F.lit(med)) if med is not None else v).alias(c))
        elif c in fit["mode"]:
            out.append(F.coalesce(q(c).cast("string"), F.lit(fit["mode"][c])).alias(c))
        else:
            out.append(q(c))
    return df.select(*out)


def standardize_text(c):
    """Category text: trim, whitespace runs -> '_' (PRJ9)."""
    return F.regexp_replace(F.trim(c), r"\s+", "_")


def level_table(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, level, code): sorted levels of every column, numbered from 0.

    A table at any number of levels; its order is found by a distributed running count.
    """
    each = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), q(c).cast("string").alias("level"))
        for c in cols])).alias("kv")).select("kv.*").where(F.col("level").isNotNull()).distinct()
    numbered = ordered_cumsum(each.withColumn("one", F.lit(1).cast("long")),
                              ["column_name", "level"], {"upto": "one"})
    first = numbered.groupBy("column_name").agg(F.min("upto").alias("first"))
    return numbered.join(F.broadcast(first), "column_name").select(
        "column_name", "level", (F.col("upto") - F.col("first")).cast("int").alias("code"))


#: most levels that may become columns of their own
MAX_LEVELS = 10_000


def fit_levels(df: DataFrame, cols: list[str], most: int = MAX_LEVELS) -> dict[str, list[str]]:
    """Sorted distinct levels per column, for encoders that make a column of each level.

    More than ``most`` of them raise: such a column is encoded by joins with ``level_table``
    (``ordinal_encode``), which serves any number.
    """
    out: dict[str, list[str]] = {c: [] for c in cols}
    few = level_table(df, cols).where(F.col("code") <= most)      # one more than allowed, at most
    for r in few.orderBy("column_name", "code").collect():
        out[r["column_name"]].append(r["level"])
    wide = [c for c, v in out.items() if len(v) > most]
    if wide:
        raise ValueError(f"more than {most} levels in {wide}: encode by level_table")
    return out


def dummy_names(levels: dict[str, list[str]], drop_first: bool = True) -> dict[str, tuple[str, str]]:
    """Dummy column -> (source column, level)."""
    return {f"{c}_{v}": (c, v) for c, lv in levels.items() for v in (lv[1:] if drop_first else lv)}


def one_hot(df: DataFrame, levels: dict[str, list[str]], drop_first: bool = True,
            keep: list[str] = ()) -> DataFrame:
    """Dummies from fitted levels (first sorted level dropped); unseen or
    missing values give all zeros, so test rows align with train columns."""
    return df.select(*[q(c) for c in keep], *[
        F.coalesce((q(c).cast("string") == F.lit(v)).cast("int"), F.lit(0)).alias(name)
        for name, (c, v) in dummy_names(levels, drop_first).items()])


def ordinal_encode(df: DataFrame, levels: DataFrame, cols: list[str],
                   keep: list[str] = ()) -> DataFrame:
    """Code = position of the value in its column's sorted levels (PRJ12), by joins with
    ``level_table``."""
    out = df.select(*[q(c) for c in keep], *[q(c).cast("string").alias(f"_v_{c}") for c in cols])
    for c in cols:
        codes = levels.where(F.col("column_name") == c).select(
            F.col("level").alias(f"_v_{c}"), F.col("code").alias(f"{c}_code"))
        out = out.join(codes, f"_v_{c}", "left").drop(f"_v_{c}")
    return out


def binary_remap(df: DataFrame, cols: list[str], mapping: dict[str, int] = BINARY_MAP) -> DataFrame:
    """Map yes/no-like text to 1/0 for the given columns."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return df.select(*[m[F.lower(F.trim(q(c).cast("string")))].cast("int").alias(c)
                       if c in cols else q(c) for c in df.columns])
