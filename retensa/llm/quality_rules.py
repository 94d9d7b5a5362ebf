"""Quality rules: base limits, then an isolation forest over rule statistics.

Random splits isolate unusual documents in few steps; the mean path length over
all trees becomes an anomaly score.  The forest is fitted on a bounded draw of
documents (``sample_rows``); the threshold is calibrated on **all** labelled rows
through a score histogram of fixed size.

Defined cases: null or empty text has no words and fails the base rules; repeated
rows are judged alike and kept apart; a null ``doc_id`` is judged, but has no label;
without documents, or without labelled rows of both kinds, only the base rules
reject.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import least_hashed, map_batches, stored
from .docstats import FIELDS, document_stats, rates, stats_frame, stats_matrix
from .words import utf8_values

#: statistics that the trees split on
RULES = ["symbol_rate", "dup_line_rate", "repeat_rate", "bang_rate", "word_length",
         "distinct_scaled", "top_rate", "short_rate", "blank_rate", "upper_rate"]
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
BINS = 4096


@dataclass
class Forest:
    """Trees as flat arrays, one row per tree: node -> feature (-1 leaf), cut, children, length."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray
    scale: float
    threshold: float = np.inf

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score in (0, 1); higher is more unusual."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            while True:
                f = self.feature[t, node]
                inner = f >= 0
                if not inner.any():
                    break
                down = np.where(x[rows, np.maximum(f, 0)] < self.cut[t, node],
                                self.left[t, node], self.right[t, node])
                node = np.where(inner, down, node)
            total += self.length[t, node]
        return 2.0 ** (-total / max(len(self.feature), 1) / self.scale)


def expected_length(n: int) -> float:
    """Mean path length of an unsuccessful search in a binary tree of ``n`` points."""
    if n <= 1:
        return 0.0
    return 2.0 * (np.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def grow_forest(x: np.ndarray, trees: int, tree_rows: int, seed: int) -> Forest | None:
    """Isolation trees on draws of ``tree_rows`` rows of ``x``; None without two rows."""
    rng = np.random.default_rng(seed)
    rows = min(tree_rows, len(x))
    if rows < 2:
        return None
    depth_limit = int(np.ceil(np.log2(rows)))
    grown = []
    for _ in range(trees):
        nodes: list[list[float]] = []
        todo = [(rng.choice(len(x), rows, replace=False), 0, -1, 0)]
        while todo:
            members, depth, parent, side = todo.pop()
            me = len(nodes)
            nodes.append([-1, 0.0, 0, 0, depth + expected_length(len(members))])
            if parent >= 0:
                nodes[parent][side] = me
            if depth == depth_limit or len(members) < 2:
                continue
            lo, hi = x[members].min(axis=0), x[members].max(axis=0)
            usable = np.flatnonzero(hi > lo)
            if not len(usable):
                continue
            f = int(rng.choice(usable))
            cut = rng.uniform(lo[f], hi[f])
            below = x[members, f] < cut
            if below.all() or not below.any():
                continue
            nodes[me][0], nodes[me][1] = f, cut
            todo += [(members[below], depth + 1, me, 2), (members[~below], depth + 1, me, 3)]
        grown.append(nodes)
    wide = max(map(len, grown))
    table = np.zeros((trees, wide, 5))
    table[:, :, 0] = -1
    for t, nodes in enumerate(grown):
        table[t, :len(nodes)] = nodes
    whole = [table[:, :, i].astype(np.int64) for i in (0, 2, 3)]
    return Forest(whole[0], table[:, :, 1], whole[1], whole[2], table[:, :, 4],
                  expected_length(rows))


def rule_values(stats: np.ndarray) -> np.ndarray:
    values, names = rates(stats)
    return values[:, [names.index(r) for r in RULES]]


def base_failed(stats: np.ndarray) -> np.ndarray:
    words, repeats = stats[:, FIELDS.index("n_words")], stats[:, FIELDS.index("n_repeat_words")]
    return (words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * words)


def fit(stats: DataFrame, labels: DataFrame, sample_rows: int = 8192, trees: int = 256,
        tree_rows: int = 32, max_false_reject: float = 0.004, seed: int = 7) -> Forest | None:
    """Forest on the ``sample_rows`` rows of least hash that pass the base rules, threshold on
    all labelled rows.

    The threshold rejects the most rows of label 0, less the rows of label 1 it loses,
    while it loses at most ``max_false_reject`` of label 1.
    """
    passing = stats.where((F.col("n_words") >= MIN_WORDS) & (
        100 * F.col("n_repeat_words") <= MAX_REPEAT_PERCENT * F.col("n_words")))
    rows = least_hashed(passing, sample_rows, "doc_id", *FIELDS).select(*FIELDS).collect()
    x = rule_values(np.array([list(r) for r in rows], np.int64).reshape(len(rows), len(FIELDS)))
    forest = grow_forest(x, trees, tree_rows, seed)
    if forest is None:
        return None

    def binned(batch):
        scores = forest.score(rule_values(stats_matrix(batch)))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array((scores * BINS).astype(np.int64))],
            names=["quality", "bin"])

    known = passing.join(
        labels.where(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int")),
        "doc_id")
    counts = map_batches(known.select("quality", *FIELDS), binned, "quality int, bin long").groupBy(
        "quality", "bin").count().collect()
    table = np.zeros((2, BINS + 1))
    for r in counts:
        table[r["quality"], r["bin"]] += r["count"]
    if not table.sum(axis=1).all():
        return forest
    # share of each label at or above every bin
    above = table[:, ::-1].cumsum(axis=1)[:, ::-1] / table.sum(axis=1, keepdims=True)
    gain = np.where(above[1] <= max_false_reject, above[0] - above[1], -1.0)
    best = int(gain.argmax())
    if gain[best] > 0:
        forest.threshold = best / BINS
    return forest


def verdicts(stats: np.ndarray, forest: Forest | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base_failed, anomaly score, kept) of every row."""
    failed = base_failed(stats)
    score = np.zeros(len(stats)) if forest is None else forest.score(rule_values(stats))
    return failed, score, ~failed & ~(score >= (np.inf if forest is None else forest.threshold))


def judge(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    anomaly and kept for every row of ``docs``."""
    stats = stored(stats_frame(docs), "rule-stats")
    forest = fit(stats, labels, **params)
    keep = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def decide(batch):
        failed, score, kept = verdicts(stats_matrix(batch), forest)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[batch.column(c) for c in keep], pa.array(failed),
             pa.array(score), pa.array(kept)],
            names=["doc_id", *keep, "base_failed", "anomaly", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(
        stats, decide, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in keep)
        + ", base_failed boolean, anomaly double, kept boolean")


def kept_documents(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """The rows of ``docs``, all columns, that the rules keep."""
    forest = fit(stored(stats_frame(docs), "rule-stats"), labels, **params)
    place = docs.columns.index("text")

    def passing(batch):
        _, _, kept = verdicts(document_stats(utf8_values(batch.column(place))), forest)
        return batch.filter(pa.array(kept)) if kept.any() else None

    return map_batches(docs, passing, T.StructType(docs.schema.fields))
