"""Whitening against numpy's own eigensolver, and the divide-and-conquer on hard spectra."""

import math

import numpy as np
import pytest

from dawnframe.llm import qdwh, whitening

ROWS = "vec_id long, embedding array<double>, whitened string, n int, component string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, "y") for i, v in rows], ROWS)


def expected(vectors, k=4):
    dims = max(map(len, vectors))
    x = np.array([[math.floor(256 * c) for c in v] + [0] * (dims - len(v)) for v in vectors])
    listed = np.unique(x, axis=0)
    n, sums = len(listed), listed.sum(axis=0)
    centred = listed - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:k], vectors.T[::-1][:k]
    return n, ((n * x - sums) ** 2).sum(axis=1), (x - sums / n) @ vectors.T / np.sqrt(values), values / np.trace(centred.T @ centred / n)


def test_agrees_with_numpy(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(300, 9)) * np.linspace(0.2, 2, 9)).round(3).tolist()
    rows = list(enumerate(vectors)) + [(1000 + i, vectors[0]) for i in range(150)]  # a third of the rows is one vector
    got = whitening.report(frame(spark, rows)).collect()
    n, deviation, white, share = expected([v for _, v in rows])
    found = {(r.vec_id, r.component): r for r in got}
    assert len(got) == len(found) == 4 * len(rows) and n == 300
    for k in range(4):
        mine = np.array([found[i, k + 1].whitened for i, _ in rows])
        assert min(np.abs(mine - white[:, k]).max(), np.abs(mine + white[:, k]).max()) < 1e-9
        assert [found[i, k + 1].explained for i, _ in rows] == pytest.approx([share[k]] * len(rows), rel=1e-9)
    assert [found[i, 1].deviation for i, _ in rows] == deviation.tolist()
    assert {r.n for r in got} == {300} and max(r.identity_error for r in got) < 1e-9


def test_odd_vectors(spark):
    good = [(1, [1.0, 2.0, 0.5]), (1, [1.0, 2.0, 0.5]), (2, [0.25, -1.0]), (None, [3.0, 0.0, 1.0]), (3, []), (4, [-0.001, 0.0, 0.0])]
    bad = [(5, None), (6, [1.0, None, 2.0]), (7, [float("nan"), 1.0, 1.0]), (8, [float("inf"), 1.0, 1.0])]
    got = whitening.report(frame(spark, good + bad)).collect()
    assert sorted((-1 if r.vec_id is None else r.vec_id) for r in got) == sorted(3 * [-1 if i is None else i for i, _ in good])
    n, deviation, _, _ = expected([v for _, v in good])
    assert {r.n for r in got} == {n} == {5}
    assert {(r.vec_id, r.deviation) for r in got} == set(zip([i for i, _ in good], deviation.tolist(), strict=True))
    assert max(r.identity_error for r in got) < 1e-9


def test_nothing_to_whiten(spark):
    assert whitening.report(frame(spark, [])).count() == whitening.report(frame(spark, [(1, None), (2, [])])).count() == 0
    one = whitening.report(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, None, 0.0)] * 4
    line = whitening.report(frame(spark, [(1, [1.0, 5.0]), (2, [2.0, 5.0])])).collect()
    assert {(r.component, None if r.whitened is None else round(abs(r.whitened), 9)) for r in line} == {(1, 1.0), (2, None)}


def test_sums_stay_exact_beyond_longs(spark):
    got = whitening.report(frame(spark, [(1, [1e12, 1.0]), (2, [-1e12, 2.0]), (3, [1e300, 0.0])])).collect()
    assert len(got) == 6 and {r.deviation for r in got} == {None}
    model = whitening.fit(frame(spark, [(1, [1e300]), (2, [1e300, 0.0]), (3, [3.0])]), components=1)
    assert (model.n, model.sums) == (2, (2**63 - 1 + 768, 0))
    kept = whitening.whiten(frame(spark, [(1, [1e15])]), whitening.fit(frame(spark, [(1, [1e15]), (2, [0.0])])))
    assert kept.first().deviation == (2 * 256 * 10**15 - 256 * 10**15) ** 2 and kept.columns == ["vec_id", "n", "component", "whitened", "deviation"]


def turned(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))[0]
    return q @ np.diag(values) @ q.T


@pytest.mark.parametrize("matrix", [
    np.eye(5), np.zeros((3, 3)), np.array([[2.0]]), np.array([[1.0, 1.0], [1.0, 1.0]]), np.array([[0.0, 1.0], [1.0, 0.0]]),
    turned([5.0] * 8 + [3.0] * 8 + [0.0] * 8), turned(10.0 ** -np.arange(24)), turned(1 + 1e-13 * np.arange(24)), turned(1 + 1e-9 * np.arange(24)), turned(np.linspace(-3, 7, 40)),
])
@pytest.mark.parametrize("count", [None, 3])
def test_divide_and_conquer(matrix, count):
    values, vectors = qdwh.leading(matrix, count)
    size = np.linalg.norm(matrix) or 1.0
    assert len(values) == min(len(matrix), count or len(matrix))
    assert np.abs(values - np.linalg.eigvalsh(matrix)[::-1][: len(values)]).max() < 1e-14 * size * len(matrix)
    assert np.abs(vectors @ matrix - values[:, None] * vectors).max() < 1e-14 * size * len(matrix)
    assert np.abs(vectors @ vectors.T - np.eye(len(values))).max() < 1e-13


def test_polar_factor_of_an_ill_conditioned_matrix():
    u = qdwh.polar(turned([1.0, 1e-3, 1e-9, -1e-14, -1.0]))
    assert np.abs(u @ u - np.eye(5)).max() < 1e-13
