"""Verdicts and scores of the trained models against plain walks of the same trees, row by row."""

import bisect
import math

import numpy as np
import pytest

from retensa.llm import quality_classifier, quality_rules
from retensa.llm.docstats import FIELDS, document_stats, rates, stats_frame

from ..conftest import SF_SMALL
from .test_operators import labels_frame


def labelled(rows):
    """Labels of both kinds for rows of every awkward kind; a few ids twice, one null, one unknown."""
    ids = sorted({d for d, _ in rows if d is not None})
    out = [(d, int(len(t or "") % 3 > 0), 0) for d, t in rows if d in ids[::2]]
    return out + out[:3] + [(None, 1, 0), (10 ** 9, 0, 0), (ids[0], 7, 0), (ids[1], None, 0)]


@pytest.fixture(scope="module", params=["small", "awkward"])
def case(request, spark, edge, edge_rows):
    if request.param == "awkward":
        rows = list(edge_rows)
        return edge, rows, labels_frame(spark, labelled(rows)), labelled(rows)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    return docs, rows, labels, [tuple(r) for r in labels.collect()]


def plain_path(forest, t, x):
    node = 0
    while forest.feature[t, node] >= 0:
        side = forest.left if x[forest.feature[t, node]] < forest.cut[t, node] else forest.right
        node = side[t, node]
    return forest.length[t, node]


def test_rule_verdicts(case):
    docs, rows, labels, known = case
    params = {"sample_rows": 100, "trees": 40, "max_false_reject": 0.2}
    forest = quality_rules.fit(stats_frame(docs), labels, **params)
    stats = document_stats([(t or "").encode() for _, t in rows])
    values = quality_rules.rule_values(stats)
    score = [2 ** (-sum(plain_path(forest, t, x) for t in range(len(forest.feature)))
                   / len(forest.feature) / forest.scale) for x in values]
    words, repeats = (stats[:, FIELDS.index(c)].tolist() for c in ("n_words", "n_repeat_words"))
    failed = [w < 50 or 100 * r > 50 * w for w, r in zip(words, repeats)]
    # the threshold, by trying every bin on every labelled row
    bins = {0: [], 1: []}
    for (doc_id, _), s, bad in zip(rows, score, failed):
        for label_id, quality, *_ in known:
            if label_id is not None and label_id == doc_id and quality in (0, 1) and not bad:
                bins[quality].append(int(s * quality_rules.BINS))
    threshold = math.inf
    if bins[0] and bins[1]:
        best = 0
        for b in range(quality_rules.BINS + 1):
            lost = sum(x >= b for x in bins[1]) / len(bins[1])
            gain = sum(x >= b for x in bins[0]) / len(bins[0]) - lost
            if lost <= 0.2 and gain > best + 1e-12:
                best, threshold = gain, b / quality_rules.BINS
    assert forest.threshold == threshold
    expected = sorted((str(d), bad, round(s, 9), not bad and not s >= threshold)
                      for (d, _), s, bad in zip(rows, score, failed))
    got = quality_rules.judge(docs, labels, **params).collect()
    assert sorted((str(r["doc_id"]), r["base_failed"], round(r["anomaly"], 9), r["kept"]) for r in got) == expected
    assert len({r["kept"] for r in got}) == 2
    kept = quality_rules.kept_documents(docs, labels, **params)
    assert kept.count() == sum(e[3] for e in expected) and kept.columns == docs.columns


def test_ties_at_the_threshold(spark):
    """Rows of one score share a side of the threshold, however they are labelled."""
    good = " ".join(f"word{i} of{i} a{i} text{i}" for i in range(30))
    odd = good + " ### $$$ ||| !!!" * 12
    rows = [(i, good if i % 4 else odd) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = labels_frame(spark, [(i, int(i % 4 != 0), 0) for i in range(60)])
    got = quality_rules.judge(docs, labels, trees=50).collect()
    assert all(r["kept"] == (r["doc_id"] % 4 != 0) for r in got)
    mixed = labels_frame(spark, [(i, i % 2, 0) for i in range(60)])       # no threshold helps
    assert all(r["kept"] for r in quality_rules.judge(
        spark.createDataFrame([(i, good) for i in range(60)], "doc_id long, text string"), mixed).collect())


def test_classifier_scores(case):
    docs, rows, labels, _ = case
    params = {"trees": 12, "depth": 3, "bins": 16, "min_rows": 2}
    model = quality_classifier.fit(stats_frame(docs), labels, **params)
    values = rates(document_stats([(t or "").encode() for _, t in rows]))[0]
    expected = []
    for (doc_id, _), x in zip(rows, values.tolist()):
        margin = model.start
        for feature, cut, leaf in zip(model.feature.tolist(), model.cut.tolist(), model.leaf.tolist()):
            node = 0
            while node < len(feature):
                f = feature[node]
                node = 2 * node + (2 if bisect.bisect_right(model.edges[f].tolist(), x[f]) > cut[node] else 1)
            margin += leaf[node - len(feature)]
        p = 1 / (1 + math.exp(-margin))
        expected.append((str(doc_id), round(p, 9), int(p >= 0.7)))
    got = quality_classifier.score_documents(docs, labels, **params).collect()
    assert sorted((str(r["doc_id"]), round(r["score"], 9), r["predicted"]) for r in got) == sorted(expected)
    assert len({r["score"] for r in got}) > 5
    assert np.isfinite([r["score"] for r in got]).all()


def test_classifier_without_both_labels(spark, edge):
    for label in (0, 1):
        one = labels_frame(spark, [(i, label, 0) for i in range(1, 400)])
        assert {r["score"] for r in quality_classifier.score_documents(edge, one).collect()} == {float(label)}
    assert {r["score"] for r in quality_classifier.score_documents(edge, labels_frame(spark)).collect()} == {0.5}
