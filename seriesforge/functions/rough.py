"""Elastic distances in 32 bits with what the exact ones can be at least and at most: in place, one step per anti-diagonal.

Every distance here is the least sum of terms, none below zero, along a path, so the errors of a sum's terms and roundings bound its own.
LCSS counts in whole numbers and compares in 64 bits, so it is exact.  WDTW takes its terms in 64 bits, since its weights may be tiny.
"""

from __future__ import annotations

import numpy as np

from . import kernels as K

#: Pairs of a call: its arrays stay in the cache.
PAIRS = 512
#: Error of a difference of two values of at most 1, and of one operation on it, both with room.
ERROR, ROUND = 5e-7, 1.2e-7


def bounds(name: str, a: np.ndarray, b: np.ndarray, params: dict) -> np.ndarray:
    """(2, pairs): the least and the most that K.DISTANCES[name](a, b, **params) can be; the same where it was taken itself."""
    most = max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0))
    cfe = params.get("cfe", {"lcss": 1.0, "msm": 1.0}.get(name, 2.0))
    plain = name not in ("dtw", "adtw", "wdtw", "erp", "msm", "twe", "lcss") or not a.shape[1] or a.shape != b.shape or cfe not in (0.5, 1.0, 2.0) or not 1e-8 < most < 1e8
    if plain or any(np.any(~(np.abs(v) < 1e8)) for k, v in params.items() if k not in ("cfe", "window")):
        return np.broadcast_to(K.DISTANCES[name](a, b, **params), (2, len(a)))
    if name == "lcss":
        return np.broadcast_to(1.0 - _filled(name, a, b, params, 1.0) / a.shape[1], (2, len(a)))
    d = _filled(name, a, b, params, cfe).astype(float)
    steps = 2 * a.shape[1]
    # largest error of the cost of a point pair, two pairs a step for twe
    point = 0.0 if name == "wdtw" else {0.5: (ERROR * most) ** 0.5, 1.0: ERROR * most, 2.0: 4.2 * most * ERROR * most}[cfe] * (2 if name == "twe" else 1)
    off, share = steps * (point + 1e-36), (2 * steps + 60) * ROUND
    return np.stack([d * (1 - share) - off, d * (1 + share) + off])


def _filled(name: str, a: np.ndarray, b: np.ndarray, params: dict, cfe: float) -> np.ndarray:
    """Last cell of the matrix, as kernels._fill has it."""
    p, n = a.shape
    whole = name == "lcss"
    kind, outside = (np.float64, 0) if whole else (np.float32, np.inf)
    window = params.get("window")
    w = n if window is None else window
    along = lambda v: np.ascontiguousarray(v.T, kind)
    against = lambda v: np.ascontiguousarray(v.T[::-1], kind)
    value = lambda key, default: np.asarray(params.get(key, default), kind)
    fine = np.float64 if name == "wdtw" else kind
    x, y, scratch, other = np.ascontiguousarray(a.T, fine), np.ascontiguousarray(b.T[::-1], fine), np.empty((n, p), fine), np.empty((n, p), kind)
    row0 = col0 = None
    if name == "wdtw":
        g = params.get("g", 0.05)
        weights = np.atleast_2d(K.wdtw_weights(np.reshape(g, (-1, 1)), n)).T
        weights = np.concatenate([weights[:0:-1], weights])  # of i - j from 1 - n to n - 1
    elif name == "erp":
        c = K.point_cost(cfe)
        gap = np.reshape(params.get("gap", 0.0), (-1, 1))
        gaps = c(a, gap), c(b, gap)
        xg, yg = along(gaps[0]), against(gaps[1])
        col0, row0 = (np.concatenate([np.zeros((p, 1)), np.cumsum(v, axis=1)], axis=1).T.astype(kind) for v in gaps)
        if window is not None:
            row0[window + 1:] = col0[window + 1:] = np.inf
    elif name in ("msm", "twe"):
        pa, pb = (K._previous(v, None if name == "msm" else 0.0) for v in (a, b))
        px, py = along(pa), against(pb)
        if name == "twe":
            nu, lam = (np.reshape(params.get(k, v), (-1, 1)) for k, v in (("nu", 0.001), ("lam", 1.0)))
            xs, ys = along((a - pa) * (a - pa) + nu + lam), against((b - pb) * (b - pb) + nu + lam)
            twice = (2 * nu[:, 0]).astype(kind)
    penalty, cost, epsilon = value("penalty", 0.0), value("cost", 1.0), value("epsilon", 0.1)
    cell = (np.uint8 if n < 255 else np.int32) if whole else kind
    match = np.empty((n, p), bool)
    two, before, now = (np.full((n + 2, p), outside, cell) for _ in range(3))  # the row n + 1 is never inside
    before[0] = 0
    for s in range(1, 2 * n + 1):
        lo, hi = max(1, s - n, -(-(s - w) // 2)), min(n, s - 1, (s + w) // 2)
        now[max(0, lo - 1)] = outside
        now[min(n + 1, hi + 1)] = outside
        if s <= n:
            now[0] = outside if row0 is None else row0[s]
            now[s] = outside if col0 is None else col0[s]
        if lo > hi:
            if s == 2 * n:
                now[n] = outside
            two, before, now = before, now, two
            continue
        k = hi - lo + 1
        out, left, diag, top = now[lo:hi + 1], before[lo:hi + 1], two[lo - 1:hi], before[lo - 1:hi]
        i, j = slice(lo - 1, hi), slice(n - s + lo, n - s + hi + 1)
        c, e = scratch[:k], other[:k]
        np.subtract(x[i], y[j], out=c)
        if cfe == 2:
            np.multiply(c, c, out=c)
        else:
            np.abs(c, out=c)
            if cfe == 0.5:
                np.sqrt(c, out=c)
        if whole:
            np.less(c, epsilon, out=match[:k])
            np.add(diag, match[:k], out=out, casting="unsafe")
            np.maximum(out, left, out=out)
            np.maximum(out, top, out=out)
        elif name in ("dtw", "wdtw", "adtw"):
            if name == "wdtw":
                first = 2 * lo - s + n - 1
                e[:] = np.multiply(c, weights[first:first + 2 * k - 1:2], out=c)
                c = e
            np.minimum(left, top, out=out)
            if name == "adtw":
                np.add(out, penalty, out=out)
            np.minimum(out, diag, out=out)
            np.add(out, c, out=out)
        elif name == "erp":
            np.add(diag, c, out=c)
            np.add(left, yg[j], out=out)
            np.minimum(out, c, out=out)
            np.add(top, xg[i], out=c)
            np.minimum(out, c, out=out)
        elif name == "msm":
            np.add(diag, c, out=out)
            for new, previous, far, come in ((x[i], px[i], y[j], top), (y[j], py[j], x[i], left)):
                np.minimum(previous, far, out=c)
                np.maximum(previous, far, out=e)
                np.maximum(new, c, out=c)
                np.minimum(c, e, out=c)
                np.subtract(new, c, out=c)
                np.abs(c, out=c)
                np.add(c, cost, out=c)
                np.add(c, come, out=c)
                np.minimum(out, c, out=out)
        else:
            np.subtract(px[i], py[j], out=e)
            np.multiply(e, e, out=e)
            np.add(c, e, out=c)
            np.add(diag, c, out=out)
            np.multiply(twice, np.abs(2 * np.arange(lo, hi + 1, dtype=kind) - s)[:, None], out=e)
            np.add(out, e, out=out)
            np.add(top, xs[i], out=c)
            np.minimum(out, c, out=out)
            np.add(left, ys[j], out=c)
            np.minimum(out, c, out=out)
        two, before, now = before, now, two
    return before[n].copy()
