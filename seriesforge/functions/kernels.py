"""Elastic distances for batches of pairs: one numpy step per anti-diagonal, all pairs of a batch at once.

Of the parameters, penalty, g, gap, epsilon, cost, nu and lam may be one value for each pair.

a is (pairs, n), b is (pairs, m).  Cell (i, j) of the padded matrix stands for the first i points of a and j of b; on an
anti-diagonal its three neighbours lie on the two diagonals before, so n + m vector steps fill every matrix.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

INF = math.inf


def point_cost(exponent: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """|x - y| ** exponent; 1, 2 and 0.5 without pow."""
    if exponent == 1:
        return lambda x, y: np.abs(x - y)
    if exponent == 2:
        return lambda x, y: (x - y) * (x - y)
    if exponent == 0.5:
        return lambda x, y: np.sqrt(np.abs(x - y))
    return lambda x, y: np.abs(x - y) ** exponent


def _fill(along_a, along_b, cell, window=None, row0=None, col0=None, outside=INF):
    """Last cell of the matrix.

    along_a, along_b: arrays (n, pairs) and (m, pairs) that the cells need.  cell(as, bs, off, left, diag, top) gets their
    slices for one anti-diagonal (views, (cells, pairs)) and off = i - j.  row0, col0: border values (m + 1, pairs), (n + 1, pairs).
    Three buffers take turns; only the cells next to the band are reset.
    """
    n, p = along_a[0].shape
    m = along_b[0].shape[0]
    w = max(n, m) if window is None else window
    back = [x[::-1] for x in along_b]
    two, before, now = (np.full((n + 2, p), outside) for _ in range(3))  # the row n + 1 is never inside
    before[0] = 0.0
    for s in range(1, n + m + 1):
        lo, hi = max(1, s - m, -(-(s - w) // 2)), min(n, s - 1, (s + w) // 2)
        now[max(0, lo - 1)] = outside
        now[min(n + 1, hi + 1)] = outside
        if s <= m:
            now[0] = outside if row0 is None else row0[s]
        if s <= n:
            now[s] = outside if col0 is None else col0[s]
        if lo <= hi:
            off = (2 * np.arange(lo, hi + 1) - s)[:, None]
            now[lo:hi + 1] = cell([x[lo - 1:hi] for x in along_a], [x[m - s + lo:m - s + hi + 1] for x in back], off, before[lo:hi + 1], two[lo - 1:hi], before[lo - 1:hi])
        elif s == n + m:
            now[n] = outside
        two, before, now = before, now, two
    return before[n].copy()


def _ends(f):
    """Empty series: both empty 0, one empty infinite; a window narrower than the lengths' difference: infinite."""
    def run(a, b, *args, **kw):
        a, b = np.asarray(a, float), np.asarray(b, float)
        if not a.shape[1] or not b.shape[1]:
            return np.full(len(a), 0.0 if a.shape[1] == b.shape[1] else INF)
        if kw.get("window") is not None and abs(a.shape[1] - b.shape[1]) > kw["window"]:
            return np.full(len(a), INF)
        return f(a, b, *args, **kw)
    run.__doc__ = f.__doc__
    return run


def _t(*arrays: np.ndarray) -> list[np.ndarray]:
    return [np.ascontiguousarray(x.T) for x in arrays]


def _column(value) -> np.ndarray:
    return np.reshape(value, (-1, 1))


def _previous(x: np.ndarray, first: float | None) -> np.ndarray:
    return np.concatenate([x[:, :1] if first is None else np.full((len(x), 1), first), x[:, :-1]], axis=1)


@_ends
def dtw(a, b, cfe=2.0, window=None):
    """Dynamic time warping, within a Sakoe-Chiba band if a window is given."""
    c = point_cost(cfe)
    return _fill(_t(a), _t(b), lambda x, y, off, left, diag, top: np.minimum(np.minimum(left, diag), top) + c(x[0], y[0]), window)


@_ends
def adtw(a, b, cfe=2.0, penalty=0.0):
    """Amerced: steps off the diagonal pay a penalty."""
    c = point_cost(cfe)
    def cell(x, y, off, left, diag, top):
        d = c(x[0], y[0])
        return np.minimum(diag + d, np.minimum(left, top) + d + penalty)
    return _fill(_t(a), _t(b), cell)


def wdtw_weights(g: float, length: int, wmax: float = 1.0) -> np.ndarray:
    return wmax / (1.0 + np.exp(-g * (np.arange(length) - length / 2.0)))


@_ends
def wdtw(a, b, cfe=2.0, g=0.05, weights=None):
    """Costs weighted by the distance from the diagonal."""
    c = point_cost(cfe)
    w = np.atleast_2d(wdtw_weights(_column(g), max(a.shape[1], b.shape[1])) if weights is None else np.asarray(weights, float)).T
    return _fill(_t(a), _t(b), lambda x, y, off, left, diag, top: np.minimum(np.minimum(left, diag), top) + c(x[0], y[0]) * w[np.abs(off[:, 0])])


@_ends
def erp(a, b, cfe=2.0, gap=0.0, window=None):
    """Edit distance with real penalty: gaps cost the distance to the gap value, on the borders too (within the window)."""
    c = point_cost(cfe)
    ga, gb = c(a, _column(gap)), c(b, _column(gap))
    def border(costs):
        out = np.concatenate([np.zeros((len(costs), 1)), np.cumsum(costs, axis=1)], axis=1).T
        if window is not None:
            out[window + 1:] = INF
        return out
    cell = lambda x, y, off, left, diag, top: np.minimum(np.minimum(diag + c(x[0], y[0]), left + y[1]), top + x[1])
    return _fill(_t(a, ga), _t(b, gb), cell, window, border(gb), border(ga))


@_ends
def lcss(a, b, epsilon=0.1, window=None):
    """1 - longest common subsequence / shorter length; points match strictly within epsilon."""
    def cell(x, y, off, left, diag, top):
        return np.where(np.abs(x[0] - y[0]) < epsilon, diag + 1.0, np.maximum(np.maximum(left, diag), top))
    return 1.0 - _fill(_t(a), _t(b), cell, window, outside=0.0) / min(a.shape[1], b.shape[1])


@_ends
def msm(a, b, cost=1.0):
    """Move, split, merge."""
    def moved(new, prev, other):
        between = ((prev <= new) & (new <= other)) | ((prev >= new) & (new >= other))
        return np.where(between, cost, cost + np.minimum(np.abs(new - prev), np.abs(new - other)))
    def cell(x, y, off, left, diag, top):
        return np.minimum(np.minimum(diag + np.abs(x[0] - y[0]), top + moved(x[0], x[1], y[0])), left + moved(y[0], y[1], x[0]))
    return _fill(_t(a, _previous(a, None)), _t(b, _previous(b, None)), cell)


@_ends
def twe(a, b, nu=0.001, lam=1.0):
    """Time warp edit with squared costs; the first cell has no previous term."""
    pa, pb = _previous(a, 0.0), _previous(b, 0.0)
    def cell(x, y, off, left, diag, top):
        match = diag + (x[0] - y[0]) * (x[0] - y[0]) + (x[1] - y[1]) * (x[1] - y[1]) + 2 * nu * np.abs(off)
        return np.minimum(np.minimum(match, top + x[2]), left + y[2])
    return _fill(_t(a, pa, (a - pa) * (a - pa) + _column(nu) + _column(lam)), _t(b, pb, (b - pb) * (b - pb) + _column(nu) + _column(lam)), cell)


def dtw_wr(a, b, cfe=2.0, window=None) -> tuple[np.ndarray, np.ndarray]:
    """DTW and the largest deviation from the diagonal along the chosen path; ties prefer diagonal, left, top."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    p, n, m = len(a), a.shape[1], b.shape[1]
    if not n or not m or (window is not None and abs(n - m) > window):
        return np.full(p, 0.0 if n == m else INF), np.full(p, 0 if n == m else -1, np.int64)
    c, w = point_cost(cfe), max(n, m) if window is None else window
    cost, dev = np.full((p, m + 1), INF), np.zeros((p, m + 1), np.int64)
    cost[:, 0] = 0.0
    for i in range(n):
        new, far = np.full((p, m + 1), INF), np.zeros((p, m + 1), np.int64)
        for j in range(max(0, i - w), min(m, i + w + 1)):
            best, d = cost[:, j], dev[:, j]
            for other, od in ((new[:, j], far[:, j]), (cost[:, j + 1], dev[:, j + 1])):
                less = other < best
                best, d = np.where(less, other, best), np.where(less, od, d)
            new[:, j + 1], far[:, j + 1] = best + c(a[:, i], b[:, j]), np.maximum(d, abs(i - j))
        cost, dev = new, far
    return cost[:, m], np.where(np.isinf(cost[:, m]), -1, dev[:, m])


def directa(a, b, cfe=2.0):
    """Point by point, no root; unequal lengths are infinitely far."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    if a.shape[1] != b.shape[1]:
        return np.full(len(a), INF)
    return point_cost(cfe)(a, b).sum(axis=1)


def ed_prefix(a, b, cfe=2.0):
    """directa over the common prefix."""
    k = min(np.shape(a)[1], np.shape(b)[1])
    return directa(np.asarray(a)[:, :k], np.asarray(b)[:, :k], cfe)


def minkowski(a, b, p=2.0):
    return directa(a, b, p) ** (1.0 / p)


def lorentzian(a, b):
    return np.log1p(np.abs(np.asarray(a, float) - np.asarray(b, float))).sum(axis=1)


def cross_correlation(a, b):
    """All lags -(L-1)..L-1 by FFT, padded to a power of two."""
    n = max(a.shape[1], b.shape[1])
    size = 1 << (2 * n - 1).bit_length()
    full = np.fft.irfft(np.fft.rfft(a, size) * np.conj(np.fft.rfft(b, size)), size)
    return np.concatenate([full[:, size - (n - 1):], full[:, :n]], axis=1)


def max_cc(a, b):
    return cross_correlation(np.asarray(a, float), np.asarray(b, float)).max(axis=1)


def max_ncc_b(a, b):
    """Largest cross-correlation over the longer length."""
    return max_cc(a, b) / max(a.shape[1], b.shape[1])


def max_ncc_c(a, b):
    """Largest cross-correlation over both norms; NaN where a norm is zero."""
    norm = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
    return np.where(norm > 0, max_cc(a, b) / np.where(norm > 0, norm, 1.0), np.nan)


def sbd(a, b):
    """1 - the largest cross-correlation over both norms; 2 where a norm is zero."""
    c = max_ncc_c(np.asarray(a, float), np.asarray(b, float))
    return np.where(np.isnan(c), 2.0, 1.0 - c)


def envelopes(x, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Moving maximum and minimum over [i-w, i+w]."""
    x = np.asarray(x, float)
    n = x.shape[1]
    w = min(w, n - 1)
    pad = lambda v: np.pad(x, ((0, 0), (w, w)), constant_values=v)
    view = lambda v: np.lib.stride_tricks.sliding_window_view(pad(v), 2 * w + 1, axis=1)
    return view(-INF).max(axis=2), view(INF).min(axis=2)


def _outside(q, upper, lower, c):
    return np.where(q > upper, c(q, upper), np.where(q < lower, c(q, lower), 0.0))


def lb_keogh(a, b, cfe=2.0, window=0):
    """Lower bound of the banded distance: points of a outside the envelope of b."""
    up, low = envelopes(b, window)
    return _outside(np.asarray(a, float), up, low, point_cost(cfe)).sum(axis=1)


def lb_keogh2j(a, b, cfe=2.0, window=0):
    return np.maximum(lb_keogh(a, b, cfe, window), lb_keogh(b, a, cfe, window))


def _bands(a, b, c, v, window):
    """First and last point exactly, then the least cost of each of the v outermost bands on both sides."""
    n = a.shape[1]
    total = c(a[:, 0], b[:, 0]) + (c(a[:, -1], b[:, -1]) if n > 1 else 0.0)
    k = min(n // 2, v)
    for i in range(1, k):
        lo, r = max(0, i - window), n - 1 - i
        left = np.minimum.reduce([np.minimum(c(a[:, j], b[:, i]), c(a[:, i], b[:, j])) for j in range(lo, i + 1)])
        right = np.minimum.reduce([np.minimum(c(a[:, j], b[:, r]), c(a[:, r], b[:, j])) for j in range(r, min(n, r + window + 1))])
        total = total + left + right
    return total, max(1, k), n - max(1, k)


def lb_enhanced(a, b, cfe=2.0, window=0, v=5):
    """Bands at both ends and Keogh in between."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    c = point_cost(cfe)
    total, lo, hi = _bands(a, b, c, v, window)
    up, low = envelopes(b, window)
    return total + _outside(a, up, low, c)[:, lo:hi].sum(axis=1)


def lb_enhanced2j(a, b, cfe=2.0, window=0, v=5):
    return np.maximum(lb_enhanced(a, b, cfe, window, v), lb_enhanced(b, a, cfe, window, v))


def lb_webb(a, b, cfe=2.0, window=0):
    """Keogh of a against b's envelope, plus what points of b outside a's envelope must add.

    A point of b beyond a's envelope adds its whole distance if all of a in its reach is free on that side: within b's envelope, or
    charged on the other side in a way that leaves this one alone.  Else it adds what exceeds the envelope of b's envelope.
    One step per position, all pairs at once; a window longer than the series leaves Keogh alone.
    """
    a, b = np.asarray(a, float), np.asarray(b, float)
    c, n, w = point_cost(cfe), a.shape[1], window
    up_a, low_a = envelopes(a, w)
    up_b, low_b = envelopes(b, w)
    total = _outside(a, up_b, low_b, c).sum(axis=1)
    if w > n:
        return total
    high, low = a > up_b, a < low_b
    low &= ~high
    inside = ~high & ~low
    spared = {"below": high & (up_b >= envelopes(low_a, w)[0]), "above": low & (low_b <= envelopes(up_a, w)[1])}
    reset = {"below": high & ~spared["below"], "above": low & ~spared["above"]}
    run = {side: np.full(len(a), w) for side in spared}
    beyond = {"above": (b > up_a, up_a, envelopes(low_b, w)[0]), "below": (b < low_a, low_a, envelopes(up_b, w)[1])}
    for i in range(n + w):
        if i < n:
            for side in run:
                run[side] = np.where(reset[side][:, i], 0, run[side] + (inside[:, i] | spared[side][:, i]))
        if (j := i - w) < 0:
            continue
        for side, (out, edge, inner) in beyond.items():
            free = run[side] > 2 * w if i < n else run[side] >= n + w - j
            x, e, z = b[:, j], edge[:, j], inner[:, j]
            partly = (x > z) & (z >= e) if side == "above" else (x < z) & (z <= e)
            total += np.where(out[:, j], np.where(free, c(x, e), np.where(partly, c(x, e) - c(z, e), 0.0)), 0.0)
    return total


def with_cutoff(d: np.ndarray, cutoff: float) -> np.ndarray:
    """Costs above a finite cutoff become infinite; an infinite or NaN cutoff changes nothing."""
    return d if not math.isfinite(cutoff) else np.where(d <= cutoff, d, INF)


DISTANCES: dict[str, Callable] = {"directa": directa, "ed_prefix": ed_prefix, "dtw": dtw, "cdtw": dtw, "adtw": adtw, "wdtw": wdtw, "erp": erp, "lcss": lcss, "msm": msm, "twe": twe,
                                  "minkowski": minkowski, "lorentzian": lorentzian, "sbd": sbd, "max_cc": max_cc, "max_ncc_b": max_ncc_b, "max_ncc_c": max_ncc_c, "lb_keogh": lb_keogh, "lb_keogh2j": lb_keogh2j,
                                  "lb_enhanced": lb_enhanced, "lb_enhanced2j": lb_enhanced2j, "lb_webb": lb_webb}


def multivariate(name: str, a: list, b: list, **params) -> np.ndarray:
    """Independent channels: the sum of their distances."""
    return np.sum([DISTANCES[name](x, y, **params) for x, y in zip(a, b, strict=True)], axis=0)
