"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are cut into at most ``bins`` quantile bins; every tree is complete, so a
row's leaf is found by ``depth`` vectorised steps over flat arrays.  The model is
fitted on a bounded draw (``sample_rows``) of labelled rows that are not held out; all
documents are scored where they lie.

Defined cases: null and empty texts have all-zero statistics and are scored like any
other; repeated rows score alike; a null ``doc_id`` is never held out and has no label;
without labels of both kinds every score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import least_hashed, map_batches, stored
from .docstats import FIELDS, rates, stats_frame, stats_matrix


@dataclass
class Boosted:
    """Complete trees as arrays: (tree, inner node) -> feature and cut bin, (tree, leaf) -> value."""

    edges: list[np.ndarray]
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    start: float

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], side="right")
                                for j, e in enumerate(self.edges)]).astype(np.int16)

    def probability(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        margin = np.full(len(x), self.start)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:      # every row stands on the same level
                right = b[rows, self.feature[t, node]] > self.cut[t, node]
                node = 2 * node + 1 + right
            margin += self.leaf[t, node - inner]
        return 1.0 / (1.0 + np.exp(-margin))


def boost(x: np.ndarray, y: np.ndarray, trees: int, depth: int, bins: int, rate: float,
          min_rows: int, penalty: float) -> Boosted:
    """Logistic boosting; per level one histogram of gradients by (node, feature, bin)."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1]))
             for j in range(x.shape[1])]
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Boosted(edges, np.zeros((trees, 2 ** depth - 1), np.int64),
                    np.full((trees, 2 ** depth - 1), bins, np.int64),
                    np.zeros((trees, 2 ** depth)), float(np.log(share / (1 - share))))
    b = model.binned(x).astype(np.int64)
    features = b.shape[1]
    cell = b + np.arange(features) * bins
    margin = np.full(len(y), model.start)
    for t in range(trees):
        p = 1.0 / (1.0 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, wide = 2 ** level - 1, 2 ** level
            flat = ((node - first) * features * bins)[:, None] + cell
            sums = [np.bincount(flat.ravel(), None if w is None else np.repeat(w, features),
                                wide * features * bins).reshape(wide, features, bins).cumsum(axis=2)
                    for w in (grad, hess, None)]
            g, h, n = sums
            all_g, all_h, all_n = g[:, :, -1:], h[:, :, -1:], n[:, :, -1:]
            gain = g ** 2 / (h + penalty) + (all_g - g) ** 2 / (all_h - h + penalty) \
                - all_g ** 2 / (all_h + penalty)
            gain = np.where((n >= min_rows) & (all_n - n >= min_rows), gain, 0.0)
            best = gain.reshape(wide, -1).argmax(axis=1)
            good = gain.reshape(wide, -1)[np.arange(wide), best] > 1e-9
            model.feature[t, first:first + wide] = best // bins
            model.cut[t, first:first + wide] = np.where(good, best % bins, bins)
            right = b[np.arange(len(y)), model.feature[t, node]] > model.cut[t, node]
            node = 2 * node + 1 + right
        leaf = node - (2 ** depth - 1)
        g, h = (np.bincount(leaf, w, 2 ** depth) for w in (grad, hess))
        model.leaf[t] = -rate * g / (h + penalty)
        margin += model.leaf[t, leaf]
    return model


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id's text leaves remainder 2 by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(stats: DataFrame, labels: DataFrame, sample_rows: int = 20000, trees: int = 80,
        depth: int = 4, bins: int = 64, rate: float = 0.15, min_rows: int = 20,
        penalty: float = 1.0) -> Boosted | float:
    """Model on the ``sample_rows`` labelled, not held-out rows of least hash.

    Without both labels among them: the share of label 1, as a number.
    """
    known = stats.join(labels.where(F.col("quality").isin(0, 1)).select("doc_id", "quality"), "doc_id")
    known = known.where(~is_held_out(F.col("doc_id")))
    rows = least_hashed(known, sample_rows, "doc_id", "quality", *FIELDS).select(
        "quality", *FIELDS).collect()
    table = np.array([list(r) for r in rows], np.int64).reshape(len(rows), len(FIELDS) + 1)
    y = table[:, 0].astype(float)
    if len(np.unique(y)) < 2:
        return float(y[0]) if len(y) else 0.5
    return boost(rates(table[:, 1:])[0], y, trees, depth, bins, rate,
                 min(min_rows, max(1, len(y) // 20)), penalty)


def score_documents(docs: DataFrame, labels: DataFrame, cut: float = 0.7, **params) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""
    stats = stored(stats_frame(docs), "class-stats")
    model = fit(stats, labels, **params)

    def score(batch):
        x = rates(stats_matrix(batch))[0]
        p = np.full(len(x), model) if isinstance(model, float) else model.probability(x)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)],
                                          names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = map_batches(stats, score, f"doc_id {kind}, score double")
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= cut).cast("int").alias("predicted"))
