"""Phrases against plain counting, the quicksort against counts of tuples."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from retensa.llm import collocations

from ..conftest import SF_SMALL
from .brute import fold


def brute(rows, depth=3, least=10, top=2000, share=50):
    counts, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        f = counts.setdefault(lang, Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", fold(text)):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, depth + 1):
                f.update(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        dropped = {p[i:i + n] for p, a in found.items() for n in range(2, len(p))
                   for i in range(len(p) - n + 1) if 100 * a >= share * f[p[i:i + n]]}
        lines = []
        for p, a in found.items():
            score, k = min((10 ** 6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            if p not in dropped:
                lines.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, total[lang], -s)
                for i, (s, a, p, x, y) in enumerate(sorted(lines)[:top], 1)]
    return sorted(out)


def rows_of(df, **more):
    return sorted(tuple(r) for r in collocations.mine(df, **more).collect())


@pytest.mark.parametrize("seed", range(12))
def test_quicksort_counts_equal_partitions(seed):
    rng = np.random.default_rng(seed)
    depth, n = int(rng.integers(1, 5)), int(rng.integers(0, 400))
    names = np.minimum(rng.integers(0, 9, (n, depth)), rng.integers(1, 9, (n, depth))).astype(np.uint64)
    if seed % 3 == 0:
        names[: n // 2] = 5
    for j in range(1, depth):
        names[names[:, j - 1] == 0, j] = 0
    weight = rng.integers(1, 5, n)
    least = int(rng.integers(1, 9))
    expected = Counter()
    for row, w in zip(names.tolist(), weight.tolist()):
        for d in range(1, depth + 1):
            if row[d - 1]:
                expected[tuple(row[:d])] += w
    got = [(tuple(names[at, :d].tolist()), w) for d, pointers, counts in
           collocations.multikey_quicksort(names, weight, [least] * depth)
           for at, w in zip(pointers.tolist(), counts.tolist())]
    assert len(got) == len(dict(got))
    assert dict(got) == {p: w for p, w in expected.items() if w >= least}
    both, sums = collocations.merged(names, weight)
    assert dict(zip(map(tuple, both.tolist()), sums.tolist())) == Counter(
        {r: sum(weight[(names == r).all(axis=1)].tolist()) for r in set(map(tuple, names.tolist()))})


def prose(seed, n, words=40):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(words)] + ["É", "a.b", "x,", "the", "THE", "of"]
    return [" ".join(rng.choice(vocabulary[:rng.randint(3, len(vocabulary))])
                     + rng.choice(["", "", "", ".", "\t", "\n", "?"]) for _ in range(rng.randint(0, 60)))
            for _ in range(n)]


@pytest.mark.parametrize("params", [
    {}, {"least": 2}, {"least": 1, "depth": 2}, {"least": 3, "depth": 5, "top": 40},
    {"least": 2, "share": 80, "top": 7}])
def test_phrases(spark, params):
    rng = random.Random(4)
    rows = [(rng.choice(["de", "en", None, "und"]), t) for t in prose(1, 200, 8)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    names = {"depth": "max_words", "least": "min_count", "share": "part_share", "top": "top"}
    got = rows_of(df, **{names[k]: v for k, v in params.items()}, bucket_words=500)
    assert got == brute(rows, **params) and got


def test_small_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    assert rows_of(docs) == brute(rows)
    assert rows_of(docs, min_count=2) == brute(rows, least=2)


def test_hot_words_are_divided_and_added_up(spark, monkeypatch):
    monkeypatch.setattr(collocations, "HOT_SHARE", 12)
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 300)
    rows = [("en", t) for t in prose(2, 120, 6)] + [("en", "the of the of the of the the the " * 40)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    for depth in (2, 3, 4):
        assert rows_of(df, max_words=depth, min_count=3, bucket_words=50) == brute(rows, depth, 3)


def test_awkward_rows(spark, edge_rows):
    rows = [(i % 3 or None, t) for i, (_, t) in enumerate(edge_rows)]
    schema = "lang string, text string, names string, salt string, n string, f int, word string"
    df = spark.createDataFrame([(None if x is None else f"l{x}", t, "?", "?", "?", 1, "?")
                                for x, t in rows], schema).repartition(3)
    rows = [(None if x is None else f"l{x}", t) for x, t in rows]
    assert rows_of(df, min_count=2) == brute(rows, least=2)
    assert rows_of(spark.createDataFrame([], schema)) == []
    assert rows_of(spark.createDataFrame([(None, None, "", "", "", 1, "")], schema)) == []
    with pytest.raises(ValueError):
        collocations.mine(df, max_words=1)


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 50)
    for text in (b"a b c. " * 100, b"x" * 500, b"", b"no mark here " * 20 + b"!" + b"y " * 30):
        parts = list(collocations._cut(text))
        assert b"".join(parts) == text
        assert all(p[0] in collocations.SEPARATORS for p in parts[1:] if p)


def test_scores_pass_64_bits(spark):
    big = 10 ** 13
    counts = [(big, big + 1, big + 3), (big, big, big), (7, big, 9 * 10 ** 12), (10, 10, 11)]
    words = spark.createDataFrame([(2 * i + j + 1, "en", "w", c) for i, (_, *lr) in enumerate(counts)
                                   for j, c in enumerate(lr)], "name long, lang string, word string, f long")
    phrases = spark.createDataFrame([([2 * i + 1, 2 * i + 2], a) for i, (a, _, _) in enumerate(counts)],
                                    "names array<long>, f long")
    got = {r["names"][0]: r["score"] for r in collocations.score_phrases(phrases, words, []).collect()}
    assert got == {2 * i + 1: 10 ** 6 * a * a // (x * y) for i, (a, x, y) in enumerate(counts)}
