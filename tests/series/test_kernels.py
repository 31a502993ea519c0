"""Kernels against a plain full matrix, fixed values and properties."""

import math

import numpy as np
import pytest

from seriesforge.functions import kernels as K
from seriesforge.functions.hydra import Hydra, SparseScaler

A, B, C = np.array([[1, 2, 4, 3, 1.0]]), np.array([[1, 1, 2, 5, 3.0]]), np.array([[2, 4, 3.0]])
RNG = np.random.default_rng(5)


def naive_dtw(x, y, e, w=None, weights=None, penalty=0.0):
    n, m = len(x), len(y)
    d = np.full((n + 1, m + 1), math.inf)
    d[0, 0] = 0
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            if w is None or abs(i - j) <= w:
                c = abs(x[i - 1] - y[j - 1]) ** e * (weights[abs(i - j)] if weights is not None else 1)
                d[i, j] = min(d[i - 1, j - 1] + c, min(d[i, j - 1], d[i - 1, j]) + c + penalty)
    return d[n, m]


def naive_lcss(x, y, eps, w):
    d = np.zeros((len(x) + 1, len(y) + 1))
    for i in range(1, len(x) + 1):
        for j in range(1, len(y) + 1):
            if abs(i - j) <= w:
                d[i, j] = d[i - 1, j - 1] + 1 if abs(x[i - 1] - y[j - 1]) < eps else max(d[i - 1, j], d[i, j - 1], d[i - 1, j - 1])
    return 1 - d[-1, -1] / min(len(x), len(y))


def test_fixed_values():
    assert [K.directa(A, B, e)[0] for e in (1, 2)] == [7, 13] and abs(K.directa(A, B, 0.5)[0] - 5.242640687119) < 1e-9
    assert K.dtw(A, B)[0] == 5 and [K.dtw(A, B, window=w)[0] for w in (0, 1, 2)] == [13, 5, 5] and K.dtw(A, C, window=1)[0] == math.inf and K.dtw(A, B, 1.0)[0] == 3
    assert [K.adtw(A, B, penalty=p)[0] for p in (0, 0.5, 10)] == [5, 6, 13] and K.adtw(A, C, penalty=0.5)[0] == 6
    assert np.allclose(K.wdtw_weights(0.05, 5), [0.468791, 0.481259, 0.49375, 0.50625, 0.518741], atol=1e-6) and abs(K.wdtw(A, B, g=0.05)[0] - 2.356421) < 1e-6
    assert K.erp(A, B)[0] == 3 and K.erp(A, C)[0] == 2 and K.erp(A, B, gap=1.0, window=1)[0] == 1
    assert np.allclose([K.lcss(A, B, 0.5, window=1)[0], K.lcss(A, B, 1.5, window=1)[0], K.lcss(A, C, 0.5, window=2)[0]], [0.4, 0.2, 0])
    assert np.allclose([K.msm(A, B, 0.1)[0], K.msm(A, B, 1)[0], K.msm(A, C, 1)[0], K.twe(A, B)[0], K.twe(A, C)[0]], [3.2, 5, 5, 8.008, 8.006])
    assert [x[0].tolist() for x in K.envelopes(B, 1)] == [[1, 2, 5, 5, 5], [1, 1, 1, 2, 3]]
    assert K.lb_keogh(A, B, window=1)[0] == 4 and K.lb_keogh(B, A, window=1)[0] == 1


@pytest.mark.parametrize("n,m", [(25, 25), (20, 30), (1, 1), (2, 7)])
@pytest.mark.parametrize("w", [None, 0, 2, 6, 12, 30])
def test_matrix(n, m, w):
    x, y = RNG.random((6, n)) * 2, RNG.random((6, m)) * 2
    if w is None:
        g = K.wdtw_weights(0.3, max(n, m))
        assert np.allclose(K.wdtw(x, y, 2.0, weights=g), [naive_dtw(p, q, 2, weights=g) for p, q in zip(x, y)])
        assert np.allclose(K.adtw(x, y, 1.0, 0.3), [naive_dtw(p, q, 1, penalty=0.3) for p, q in zip(x, y)])
    for e in (1, 2, 0.5, 1.5):
        assert np.allclose(K.dtw(x, y, e, window=w), [naive_dtw(p, q, e, w) for p, q in zip(x, y)])
    if w is not None and abs(n - m) <= w:
        assert np.allclose(K.lcss(x, y, 0.3, window=w), [naive_lcss(p, q, 0.3, w) for p, q in zip(x, y)])


def test_properties():
    x, y = np.cumsum(RNG.normal(size=(200, 25)), axis=1), np.cumsum(RNG.normal(size=(200, 25)), axis=1)
    for f in (K.dtw, K.adtw, K.wdtw, K.erp, K.msm, K.twe):
        assert np.allclose(f(x, x), 0) and np.allclose(f(x, y), f(y, x))
    assert np.allclose(K.dtw(x, y, window=25), K.dtw(x, y)) and np.allclose(K.adtw(x, y, penalty=0), K.dtw(x, y))
    for w in (0, 1, 3, 8):
        d = K.dtw(x, y, window=w)
        for lb in (K.lb_keogh, K.lb_keogh2j, K.lb_enhanced, K.lb_enhanced2j, K.lb_webb):
            assert (lb(x, y, window=w) <= d + 1e-9).all()
        cost, dev = K.dtw_wr(x, y, 2.0, w)
        assert np.allclose(cost, d) and (dev <= w).all()
    assert np.allclose(K.sbd(x, x), 0) and K.sbd(np.zeros((1, 4)), np.ones((1, 4)))[0] == 2
    assert K.with_cutoff(np.array([1.0, 3.0]), 2.0).tolist() == [1, math.inf]
    e = np.zeros((1, 0))
    assert K.dtw(e, e)[0] == 0 and K.dtw(e, np.ones((1, 2)))[0] == math.inf


def test_hydra():
    x = RNG.normal(size=(7, 64))
    h = Hydra(64, groups=8, seed=1)
    f = h.transform(x)
    assert np.allclose(h.transform(x, by_group=True).reshape(7, -1), f) and np.allclose(f[3:4], h.transform(x[3:4]))
    assert f.sum() == 7 * len(h.dilations) * 4 * 2 * (64 + 63)  # one largest and one smallest answer for each group and step
    assert np.isfinite(SparseScaler().fit(f).transform(f)).all()


def _webb(a, b, w):
    """One pair, point by point: positions free above and below are counted in runs that other positions end."""
    n, sq = len(a), lambda x, y: (x - y) ** 2
    reach = lambda x, i: x[max(0, i - w):i + w + 1]
    env = lambda x, f: [f(reach(x, i)) for i in range(n)]
    ua, la, ub, lb = env(a, max), env(a, min), env(b, max), env(b, min)
    total, above, below, runs = 0.0, w, w, []
    for i in range(n):
        if a[i] > ub[i]:
            total += sq(a[i], ub[i])
            below = below + 1 if ub[i] >= max(reach(la, i)) else 0
        elif a[i] < lb[i]:
            total += sq(a[i], lb[i])
            above = above + 1 if lb[i] <= min(reach(ua, i)) else 0
        else:
            above, below = above + 1, below + 1
        runs.append((above, below))
    for j in range(n):
        whole = [r > 2 * w for r in runs[j + w]] if j + w < n else [j >= n - r + w for r in runs[-1]]
        for side, edge, inner, beyond in ((0, ua[j], max(reach(lb, j)), b[j] > ua[j]), (1, la[j], min(reach(ub, j)), b[j] < la[j])):
            between = b[j] > inner >= edge if side == 0 else b[j] < inner <= edge
            if beyond:
                total += sq(b[j], edge) if whole[side] else sq(b[j], edge) - sq(inner, edge) if between else 0.0
    return total


def test_webb_against_a_plain_loop():
    rng = np.random.default_rng(11)
    for w in (0, 1, 4, 12, 30):
        a, b = rng.normal(size=(2, 100, 30)).cumsum(axis=2) if w % 2 else rng.normal(size=(2, 100, 30))
        got = K.lb_webb(a, b, 2.0, w)
        assert np.allclose(got, [_webb(list(x), list(y), w) for x, y in zip(a, b)])
        assert (got <= K.dtw(a, b, 2.0, window=w) + 1e-9).all()
        assert w in (0, 30) or (got > K.lb_keogh(a, b, 2.0, w) + 1e-9).any()
