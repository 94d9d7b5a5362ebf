"""Churn labels for unlabelled tables (UL1-UL7).

* rules: min-max normalised role columns, weighted risk, top 30 % by the
  70th percentile;
* k-means: MLlib ``Imputer`` -> ``StandardScaler`` -> ``KMeans``;
* isolation forest: no MLlib equivalent.  Each tree's 256-row sample is
  chosen by an integer hash of (row key, tree id); trees are grown inside
  ``applyInPandas`` (one group per tree, at most 256 rows each), the forest
  (at most trees x 511 nodes, a bound fixed by the parameters) is broadcast,
  and path lengths are computed batch-wise in ``mapInPandas``.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import q
from ..functions.quantiles import quantiles_many
from .schema import ROLE_ORDER, detect_roles, numeric_columns

# ---- fixed values (must equal the reference's) -------------------------------
RULE_WEIGHTS = {"tenure": 0.3, "price_usage": 0.25, "engagement": 0.2, "complaints": 0.15,
                "satisfaction": 0.1}
LABEL_PERCENTILE = 0.70
NORM_EPS = 1e-8
N_CLUSTERS = 3
KMEANS_SEED = 42
CONTAMINATION = 0.3
N_TREES = 100
TREE_SAMPLE = 256
FALLBACK_RELIABILITY_CAP = 0.55
KEY_ROLES = ["tenure", "monetary", "usage", "satisfaction"]
RELIABILITY_LEVELS = [(0.75, "HIGH", "70-85%"), (0.60, "MODERATE", "60-75%"),
                      (0.45, "LOW", "50-65%"), (-1.0, "VERY LOW", "40-55%")]
IDEAL_RATE = 0.3
# ------------------------------------------------------------------------------


def roles(df: DataFrame) -> dict[str, list[str]]:
    out = {r: [] for r in ROLE_ORDER}
    for role, col, _ in detect_roles(df):
        out[role].append(col)
    return out


def choose_method(df: DataFrame, rl: dict[str, list[str]]) -> str:
    n_ind = sum(len(v) for v in rl.values())
    if n_ind >= 3:
        return "heuristic"
    if len(numeric_columns(df)) >= 5:
        return "clustering"
    return "anomaly"


def reliability(n_rows: int, n_numeric: int, rl: dict[str, list[str]]) -> float:
    n_ind = sum(len(v) for v in rl.values())
    s = 40 if n_ind >= 5 else 30 if n_ind >= 3 else 15 if n_ind >= 1 else 0
    s += 20 if n_rows >= 1000 else 15 if n_rows >= 500 else 10 if n_rows >= 100 else 5
    s += 20 if n_numeric >= 10 else 15 if n_numeric >= 5 else 10 if n_numeric >= 3 else 5
    s += sum(1 for k in KEY_ROLES if rl[k]) / 4 * 20
    return min(s / 100, 1.0)


def reliability_level(r: float) -> tuple[str, str]:
    for cut, level, expected in RELIABILITY_LEVELS:
        if r >= cut:
            return level, expected
    return RELIABILITY_LEVELS[-1][1], RELIABILITY_LEVELS[-1][2]


def _norm(x, lo, hi):
    return (x - F.lit(lo)) / (F.lit(hi) - F.lit(lo) + F.lit(NORM_EPS))


def heuristic_risk(df: DataFrame, key: str, rl: dict[str, list[str]]) -> DataFrame:
    """Weighted risk from the first column of each role, normalised by its max."""
    used = []
    if rl["tenure"]:
        used.append(rl["tenure"][0])
    if rl["monetary"] and rl["usage"]:
        used += [rl["monetary"][0], rl["usage"][0]]
    for r in ("engagement", "satisfaction"):
        if rl[r]:
            used.append(rl[r][0])
    num = set(numeric_columns(df))
    if rl["complaints"] and rl["complaints"][0] in num:
        used.append(rl["complaints"][0])
    used = list(dict.fromkeys(used))
    # missing values take the median first (trap T11: pandas would turn the
    # whole label vector to 0)
    med = quantiles_many(df, {c: q(c).cast("double") for c in used}, [0.5])
    val = {c: F.coalesce(q(c).cast("double"), F.lit(med[c][0])) for c in used}
    st = df.agg(*[F.min(val[c]).alias(f"lo_{c}") for c in used],
                *[F.max(val[c]).alias(f"hi_{c}") for c in used]).first()
    n = {c: _norm(val[c], st[f"lo_{c}"], st[f"hi_{c}"]) for c in used}
    risk = F.lit(0.0)
    if rl["tenure"]:
        risk = risk + (F.lit(1.0) - n[rl["tenure"][0]]) * F.lit(RULE_WEIGHTS["tenure"])
    if rl["monetary"] and rl["usage"]:
        risk = risk + n[rl["monetary"][0]] * (F.lit(1.0) - n[rl["usage"][0]]) \
            * F.lit(RULE_WEIGHTS["price_usage"])
    if rl["engagement"]:
        risk = risk + (F.lit(1.0) - n[rl["engagement"][0]]) * F.lit(RULE_WEIGHTS["engagement"])
    if rl["complaints"] and rl["complaints"][0] in num:
        risk = risk + n[rl["complaints"][0]] * F.lit(RULE_WEIGHTS["complaints"])
    if rl["satisfaction"]:
        risk = risk + (F.lit(1.0) - n[rl["satisfaction"][0]]) * F.lit(RULE_WEIGHTS["satisfaction"])
    raw = df.select(q(key), risk.alias("raw_risk"))
    mx = raw.agg(F.max("raw_risk")).first()[0]
    scaled = raw.select(key, (F.col("raw_risk") / F.lit(mx)).alias("risk_score")) \
        if mx is not None and mx > 0 else raw.select(key, F.col("raw_risk").alias("risk_score"))
    thr = quantiles_many(scaled, {"r": F.col("risk_score")}, [LABEL_PERCENTILE])["r"][0]
    return scaled.withColumn("label", (F.col("risk_score") >= F.lit(thr)).cast("int"))


def confidence(df: DataFrame, key: str, labelled: DataFrame, rl: dict[str, list[str]]) -> DataFrame:
    """balance, separation (tenure-only risk), indicator coverage, overall (UL6)."""
    n_ind = sum(len(v) for v in rl.values())
    x = df.select(key, *(rl["tenure"][:1])).join(labelled.select(key, "label"), key)
    if rl["tenure"]:
        t = rl["tenure"][0]
        st = df.agg(F.min(t).alias("lo"), F.max(t).alias("hi")).first()
        r = F.lit(0.0) + (F.lit(1.0) - _norm(q(t).cast("double"), st["lo"], st["hi"]))
    else:
        r = F.lit(0.0)
    s = x.agg(F.avg("label").alias("churn_rate"),
              F.avg(F.when(F.col("label") == 1, r)).alias("m1"),
              F.avg(F.when(F.col("label") == 0, r)).alias("m0"))
    bal = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(1.0) - F.abs(F.col("churn_rate")
                                                                        - IDEAL_RATE)) / IDEAL_RATE))
    sep = F.coalesce(F.least(F.lit(1.0), F.abs(F.col("m1") - F.col("m0")) * 2), F.lit(0.5))
    cov = F.lit(min(1.0, n_ind / 5))
    return s.select("churn_rate", bal.alias("balance_score"), sep.alias("separation_score"),
                    cov.alias("indicator_coverage"),
                    (bal * 0.3 + sep * 0.4 + cov * 0.3).alias("overall_confidence"))


def kmeans_labels(df: DataFrame, key: str, cols: list[str], k: int = N_CLUSTERS,
                  seed: int = KMEANS_SEED) -> DataFrame:
    """Median-fill, standardise, k-means; the cluster with the lowest median of
    the first numeric column is labelled 1 (UL2)."""
    filled = [f"_f_{i}" for i in range(len(cols))]
    base = df.select(key, *[q(c).cast("double").alias(c) for c in cols])
    pipe = Pipeline(stages=[
        Imputer(inputCols=cols, outputCols=filled, strategy="median"),
        VectorAssembler(inputCols=filled, outputCol="_vec"),
        StandardScaler(inputCol="_vec", outputCol="_z", withMean=True, withStd=True),
        KMeans(featuresCol="_z", predictionCol="cluster", k=k, seed=seed)])
    pred = pipe.fit(base).transform(base)
    medians = quantiles_many(pred, {i: F.when(F.col("cluster") == i, F.col(filled[0]))
                                    for i in range(k)}, [0.5])
    risky = min((m[0], i) for i, m in medians.items() if m[0] is not None)[1]
    return pred.select(key, "cluster", (F.col("cluster") == F.lit(risky)).cast("int").alias("label"))


# ---------------------------------------------------------------- isolation forest
# the tree builder and scorer run in Python workers: ship this module's code
# with them (by value) so workers need no copy of the package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
def _c(n: float) -> float:
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n


def _grow(X: np.ndarray, rng: np.random.RandomState, max_depth: int) -> list[tuple]:
    """Nodes as (node, feature, split, left, right, size); leaves have feature -1."""
    nodes = []

    def rec(idx, depth):
        nid = len(nodes)
        nodes.append(None)
        pts = X[idx]
        if depth >= max_depth or len(idx) <= 1:
            nodes[nid] = (nid, -1, 0.0, -1, -1, len(idx))
            return nid
        lo, hi = pts.min(axis=0), pts.max(axis=0)
        cand = np.where(hi > lo)[0]
        if len(cand) == 0:
            nodes[nid] = (nid, -1, 0.0, -1, -1, len(idx))
            return nid
        f = int(rng.choice(cand))
        s = float(rng.uniform(lo[f], hi[f]))
        left = idx[pts[:, f] < s]
        right = idx[pts[:, f] >= s]
        li = rec(left, depth + 1)
        ri = rec(right, depth + 1)
        nodes[nid] = (nid, f, s, li, ri, len(idx))
        return nid

    rec(np.arange(len(X)), 0)
    return nodes


def draw_plan(n: int, n_trees: int, psi: int) -> tuple[int, float]:
    """(draws per row, share of draws taken) that give every tree about ``2 * psi`` rows."""
    wanted = min(1.0, 2.0 * psi / max(n, 1)) * n_trees
    draws = max(1, math.ceil(wanted))
    return draws, wanted / draws


def tree_members(rows: DataFrame, n: int, n_trees: int, psi: int, seed: int) -> DataFrame:
    """Rows with the trees t they belong to and the hash u that ranks them there.

    A row draws as many trees as it joins on average, one where the rows are many, so no
    row is written once per tree; draws and ranks are full 64-bit hashes.
    """
    draws, share = draw_plan(n, n_trees, psi)
    cut = min((1 << 63) - 1, -(1 << 63) + int(share * ((1 << 64) - 1)))
    each = rows.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    return each.where(F.xxhash64("k", "d", F.lit(seed)) <= F.lit(cut)).withColumn(
        "t", F.pmod(F.xxhash64("d", "k", F.lit(seed + 1)), F.lit(n_trees)).cast("int")).withColumn(
        "u", F.xxhash64("k", "t", F.lit(seed + 2))).drop("d").dropDuplicates(["t", "k"])


def auto_labels(df: DataFrame, key: str, cols: list[str],
                method: str | None = None) -> tuple[DataFrame, str, float]:
    """Labels by the chosen method, the method that made them, and their reliability.

    Labels of one kind only say nothing: the isolation forest then makes them, and their
    reliability is capped.
    """
    rl = roles(df)
    method = method or choose_method(df, rl)
    build = {"heuristic": lambda: heuristic_risk(df, key, rl),
             "clustering": lambda: kmeans_labels(df, key, cols),
             "anomaly": lambda: isolation_forest_labels(df, key, cols)}
    trust = reliability(df.count(), len(numeric_columns(df)), rl)
    made = build[method]().select(key, "label")
    if method != "anomaly" and made.agg(F.min("label") == F.max("label")).first()[0] is not False:
        made, method = build["anomaly"]().select(key, "label"), "anomaly"
        trust = min(trust, FALLBACK_RELIABILITY_CAP)
    return made, method, trust


def isolation_forest_labels(df: DataFrame, key: str, cols: list[str],
                            contamination: float = CONTAMINATION, n_trees: int = N_TREES,
                            sample: int = TREE_SAMPLE, seed: int = 42) -> DataFrame:
    spark = df.sparkSession
    med = quantiles_many(df, {c: q(c).cast("double") for c in cols}, [0.5])
    st = df.agg(*[F.avg(q(c)).alias(f"m{i}") for i, c in enumerate(cols)],
                *[F.stddev_pop(q(c)).alias(f"s{i}") for i, c in enumerate(cols)],
                F.count(F.lit(1)).alias("n")).first()
    n = int(st["n"])
    z = [((F.coalesce(q(c).cast("double"), F.lit(med[c][0])) - F.lit(st[f"m{i}"]))
          / F.lit(st[f"s{i}"] if st[f"s{i}"] else 1.0)).alias(f"x{i}") for i, c in enumerate(cols)]
    X = df.select(q(key).alias("k"), *z)
    psi = min(sample, n)
    members = tree_members(X, n, n_trees, psi, seed)
    depth = int(math.ceil(math.log2(max(psi, 2))))
    xcols = [f"x{i}" for i in range(len(cols))]

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("u").head(psi)
        t = int(pdf["t"].iloc[0])
        rng = np.random.RandomState(seed * 1000 + t)
        nodes = _grow(pdf[xcols].to_numpy(dtype=float), rng, depth)
        out = pd.DataFrame(nodes, columns=["node", "feature", "split", "left", "right", "size"])
        out.insert(0, "tree", t)
        return out

    forest = members.groupBy("t").applyInPandas(
        grow, "tree int, node int, feature int, split double, left int, right int, size long")
    rows = forest.collect()          # bounded: n_trees x (2 * sample - 1) nodes
    trees: dict[int, list] = {}
    for r in rows:
        trees.setdefault(r["tree"], []).append(r)
    packed = []
    for t, nodes in sorted(trees.items()):
        nodes.sort(key=lambda r: r["node"])
        packed.append((np.array([r["feature"] for r in nodes]),
                       np.array([r["split"] for r in nodes]),
                       np.array([r["left"] for r in nodes]),
                       np.array([r["right"] for r in nodes]),
                       np.array([_c(r["size"]) for r in nodes])))
    bc = spark.sparkContext.broadcast(packed)
    cn = _c(psi)

    def score(it):
        forest_ = bc.value
        for pdf in it:
            M = pdf[xcols].to_numpy(dtype=float)
            m = len(pdf)
            rows_ = np.arange(m)
            total = np.zeros(m)
            for feat, split, left, right, cleaf in forest_:
                node = np.zeros(m, dtype=int)
                plen = np.zeros(m)
                done = np.zeros(m, dtype=bool)
                for _ in range(depth + 2):
                    f = feat[node]
                    leaf = (f < 0) & ~done
                    plen[leaf] += cleaf[node[leaf]]
                    done |= leaf
                    go = ~done
                    if not go.any():
                        break
                    g = rows_[go]
                    nd = node[go]
                    node[go] = np.where(M[g, f[go]] < split[nd], left[nd], right[nd])
                    plen[go] += 1
                total += plen
            e = total / max(len(forest_), 1)
            yield pd.DataFrame({"k": pdf["k"], "anomaly_score": np.power(2.0, -e / cn)})

    scored = X.mapInPandas(score, f"k {X.schema['k'].dataType.simpleString()}, anomaly_score double")
    cut = quantiles_many(scored, {"s": F.col("anomaly_score")}, [1 - contamination])["s"][0]
    return scored.select(F.col("k").alias(key), "anomaly_score",
                         (F.col("anomaly_score") >= F.lit(cut)).cast("int").alias("label"))
