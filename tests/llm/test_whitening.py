"""Components against a dense eigensolver, whole numbers against Python's."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from retensa.llm import feast, whitening

from ..conftest import SF_SMALL


@pytest.mark.parametrize("side", [1, 2, 3, 7, 40])
@pytest.mark.parametrize("shape", ["plain", "copies", "one", "equal", "falling", "pair"])
def test_leading_pairs(side, shape):
    x = np.random.default_rng(side).normal(size=(4 * side + 3, side))
    if shape == "copies":
        x[:, :side // 2] = x[:, side - side // 2:]
    elif shape == "one":
        x[:] = 0
        x[0, 0] = 1
    elif shape == "equal":
        x = np.concatenate([np.eye(side), -np.eye(side)])
    elif shape == "falling":
        x *= np.logspace(0, -8, side)
    elif shape == "pair" and side > 1:
        x[:, 0] = x[:, 1] * (1 + 1e-13)
    a = np.cov(x.T, bias=True).reshape(side, side)
    values, vectors = feast.leading(a, 4)
    assert len(values) == min(4, side)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:4], rtol=1e-11, atol=1e-14 * np.abs(a).max())
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13
    assert np.abs(a @ vectors - vectors * values).max() < 1e-13 * np.abs(a).max()


def test_inertia_counts():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 30):
        a = rng.normal(size=(n, n))
        a = a + a.T
        values = np.linalg.eigvalsh(a)
        for shift in [*((values[1:] + values[:-1]) / 2), values[0] - 1, values[-1] + 1]:
            assert feast.count_above(a, shift) == (values > shift).sum()
    assert feast.count_above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1
    assert feast.count_above(np.zeros((3, 3)), 0.0) == 0
    assert len(feast.leading(np.zeros((3, 3)), 2)[0]) == 2


def test_missed_pairs_are_noticed():
    with pytest.raises(ArithmeticError):
        feast.interval_pairs(np.diag([1.0, 2.0, 3.0]), 1.5, 3.5, 3, rounds=5)


def brute(rows, k=4, scale=256):
    """{row number: (n, deviation, whitened without sign, explained)} of rows (id, vector)."""
    x = {i: [int(np.floor(scale * float(c))) for c in v] for i, (_, v) in enumerate(rows)
         if v and all(c is not None and np.isfinite(c) for c in v)}
    fit = sorted(set(map(tuple, x.values())))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    u = np.array(fit, float)
    values, vectors = np.linalg.eigh(np.cov(u.T, bias=True).reshape(len(sums), -1))
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for i, v in x.items():
        off = [n * c - s for c, s in zip(v, sums)]
        w = np.abs(np.array(off) / n @ vectors[:, :k]) / np.sqrt(values[:k])
        out[i] = (n, sum(o * o for o in off), w, values[:k] / values.sum())
    return out


def rows_of(df, **more):
    return whitening.whiten(df, **more).orderBy("vec_id", "component").collect()


def test_whitening(spark):
    table = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    expected = brute(rows)
    got = {}
    for r in rows_of(table):
        got.setdefault(r["vec_id"], []).append(r)
    assert len(got) == len(rows)
    for i, (vec_id, _) in enumerate(rows):
        n, deviation, w, explained = expected[i]
        for k, r in enumerate(got[vec_id]):
            assert (r["component"], r["n"], int(r["deviation"])) == (k + 1, n, deviation)
            assert abs(abs(r["whitened"]) - w[k]) < 1e-9
            assert abs(r["explained"] - explained[k]) < 1e-12
            assert 0 <= r["identity_error"] < 1e-9


def test_sums_and_signs_do_not_depend_on_partitions(spark):
    table = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").limit(80)
    one, many = rows_of(table.coalesce(1)), rows_of(table.repartition(7, F.rand(1)))
    assert [r["deviation"] for r in one] == [r["deviation"] for r in many]
    assert np.allclose([r["whitened"] for r in one], [r["whitened"] for r in many], atol=1e-12)


SCHEMA = "vec_id long, embedding array<float>, x string, component string, label int"


def awkward(spark, rows):
    return spark.createDataFrame([(i, v, "?", "?", 0) for i, v in rows], SCHEMA).repartition(3)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [0.5 * i, -0.25 * (i % 3), 0.01 * i * i]) for i in range(9)]
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [nan, 1.0, 1.0]), (103, [inf, 1.0, 1.0]),
           (104, [-inf, 1.0, 1.0]), (105, []), (106, [1.0]), (107, [1.0] * 5)]
    extra = [(3, good[3][1]), (3, good[3][1]), (None, good[4][1]), (50, [-0.0, 0.0, -0.0])]
    got = rows_of(awkward(spark, good + bad + extra))
    expected = brute(good + extra, 3)
    assert len(got) == 3 * len(expected)
    assert sorted((r["vec_id"] is not None, r["vec_id"] or 0, int(r["deviation"])) for r in got
                  if r["component"] == 1) == sorted(
        ((good + extra)[i][0] is not None, (good + extra)[i][0] or 0, e[1])
        for i, e in expected.items())
    assert rows_of(awkward(spark, [])) == [] and rows_of(awkward(spark, bad[:6])) == []


def test_nothing_varies(spark):
    got = rows_of(awkward(spark, [(1, [2.0, 3.0]), (2, [2.0, 3.0])]))
    assert [(r["component"], r["n"], int(r["deviation"]), r["whitened"], r["explained"],
             r["identity_error"]) for r in got] == [(k, 1, 0, None, None, None) for k in (1, 2)] * 2
    line = rows_of(awkward(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(5)]))
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in line)
    assert line[0]["identity_error"] < 1e-12


def test_very_large_entries_stay_exact(spark):
    rows = [(i, [3e38 * (-1) ** i, 1e9 * i, float(i)]) for i in range(6)]
    got = [r for r in rows_of(awkward(spark, rows)) if r["component"] == 1]
    x = [[whitening.LONG_MAX if i % 2 == 0 else whitening.LONG_MIN,
          int(np.floor(256 * float(np.float32(1e9 * i)))), 256 * i] for i in range(6)]
    sums = [sum(c) for c in zip(*x)]
    for r, v in zip(got, x):
        exact = sum((6 * c - s) ** 2 for c, s in zip(v, sums))
        assert r["deviation"] is None if exact >= 10 ** 38 else int(r["deviation"]) == exact
