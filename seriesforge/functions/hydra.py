"""Random convolution dictionary features: per time step, the kernel of a group that answers most and least."""

from __future__ import annotations

import numpy as np

KERNEL_LENGTH, PER_GROUP = 9, 8


class Hydra:
    """Kernels for series of one length.  groups are shared out over the raw and the differenced series."""

    def __init__(self, length: int, groups: int = 64, seed: int = 0, kernels: np.ndarray | None = None):
        self.length, self.half = length, groups // 2
        steps = max(1, int(np.log2(max(2, (length - 1) / (KERNEL_LENGTH - 1)))) + 1)
        self.dilations = [2 ** i for i in range(steps)]
        shape = (steps, 2, self.half, PER_GROUP, KERNEL_LENGTH)
        if kernels is None:
            kernels = np.random.default_rng(seed).standard_normal(shape)
            kernels -= kernels.mean(axis=-1, keepdims=True)
            kernels /= np.abs(kernels).sum(axis=-1, keepdims=True)
        self.kernels = kernels.reshape(shape)

    def transform(self, x: np.ndarray, by_group: bool = False) -> np.ndarray:
        """(series, features): hard counts, largest and smallest answers interleaved; by_group keeps (group, kernel, 2)."""
        x = np.asarray(x, float)
        parts = []
        for di, d in enumerate(self.dilations):
            for which, series in enumerate((x, np.diff(x, axis=1))):
                padded = np.pad(series, ((0, 0), (4 * d, 4 * d)))
                windows = np.stack([padded[:, k * d:k * d + series.shape[1]].ravel() for k in range(KERNEL_LENGTH)])
                answers = (self.kernels[di, which].swapaxes(0, 1).reshape(-1, KERNEL_LENGTH) @ windows).reshape(PER_GROUP, self.half, *series.shape)
                parts.append(np.stack([_counts(answers, *best) for best in ((np.maximum, np.less), (np.minimum, np.greater))], axis=-1))
        out = np.concatenate(parts, axis=1)
        return out if by_group else out.reshape(len(x), -1)


def _counts(answers: np.ndarray, pick: np.ufunc, worse: np.ufunc) -> np.ndarray:
    """(series, group, kernel): how often each kernel's answer (kernel, group, series, time) is the best, the first of equal ones."""
    best = pick.reduce(answers, axis=0)
    free, won, out = np.ones(best.shape, bool), np.empty(best.shape, bool), np.empty((best.shape[1], len(best), PER_GROUP))
    for p in range(PER_GROUP):
        np.logical_not(worse(answers[p], best, out=won), out=won)
        won &= free
        free ^= won
        out[..., p] = np.add.reduce(np.bitwise_count(np.packbits(won, axis=-1)), axis=-1, dtype=np.uint32).T
    return out


class SparseScaler:
    """Fitted on square roots, applied to the counts themselves; zeros stay zero."""

    def fit(self, x: np.ndarray, exponent: int = 4) -> SparseScaler:
        return self.fit_moments(moments(x), exponent)

    def fit_moments(self, m: Moments, exponent: int = 4) -> SparseScaler:
        n, self.mean, squares, zeros = m
        self.sigma = np.sqrt(squares / n) + (zeros / n) ** exponent + 1e-8
        return self

    def transform(self, x: np.ndarray) -> np.ndarray:
        x = np.maximum(x, 0)
        return (x - self.mean) * (x != 0) / self.sigma


#: Rows, and per feature the mean of the square roots, the sum of their squared deviations, and the zeros.
Moments = tuple[int, np.ndarray, np.ndarray, np.ndarray]


def moments(x: np.ndarray) -> Moments:
    x = np.sqrt(np.maximum(x, 0))
    mean = x.mean(axis=0)
    return len(x), mean, ((x - mean) ** 2).sum(axis=0), (x == 0).sum(axis=0)


def merged(a: Moments, b: Moments) -> Moments:
    """Moments of the rows of both; from deviations, so that a constant feature keeps none."""
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + gap ** 2 * (a[0] * b[0] / n), a[3] + b[3]
