"""Pair distances, 1-NN search and leave-one-out parameter search.

All pairs of two tables are a block nested loop: both sides are packed into hash blocks of up to BLOCK series on average, every
block pair is one row, a numpy kernel fills the distances of the block pair and keeps the nearest per query and
parameter only, and a map-side-combined min over structs merges them.  Neither side is collected.  A table that is searched in
itself under a warping distance meets each block pair once.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K

#: Most series of a block on average; tables with fewer than BLOCKS such blocks have smaller ones, of LEAST series or more.
BLOCK, BLOCKS, LEAST = 2048, 8, 64
#: Queries whose distances to a block are held at once.
SLICE = 256
#: Series near a query in a wider window whose distances bound its least in a narrower one.
FEW = 8


def rows_distance(name: str, a: list, b: list, params: dict) -> np.ndarray:
    """Distances of a[i] and b[i]; one kernel call for each pair of lengths."""
    out, groups = np.empty(len(a)), defaultdict(list)
    for i, (x, y) in enumerate(zip(a, b)):
        groups[len(x), len(y)].append(i)
    for at in groups.values():
        out[at] = K.DISTANCES[name](np.array([a[i] for i in at], float).reshape(len(at), -1), np.array([b[i] for i in at], float).reshape(len(at), -1), **params)
    return out


def distance(name: str, a: Column, b: Column, cutoff: float = float("inf"), **params) -> Column:
    """Distance of two series columns, Arrow batches in numpy; infinite above the cutoff."""
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(K.with_cutoff(rows_distance(name, list(x), list(y), params), cutoff))
    return run(a, b)


def consecutive_pairs(series: DataFrame) -> DataFrame:
    """(id_a, id_b, a, b) for ids i and i + 1: an equi-join."""
    left, right = series.select(F.col("series_id").alias("id_a"), F.col("values").alias("a")), series.select(F.col("series_id").alias("id_b"), F.col("values").alias("b"))
    return left.join(right, F.col("id_b") == F.col("id_a") + 1)


def _blocks(series: DataFrame, prefix: str, most: int = BLOCK, blocks: int = BLOCKS) -> DataFrame:
    rows = series.count()
    n = max(1, -(-rows // most), min(blocks, -(-rows // LEAST)))
    packed = series.select((F.pmod(F.xxhash64("series_id"), F.lit(n))).alias(f"{prefix}_block"), F.struct("series_id", F.col("label").cast("string").alias("label"), "values").alias("s"))
    return packed.groupBy(f"{prefix}_block").agg(F.collect_list("s").alias(prefix))


#: Error of a difference of two values of at most 1 in 32 bits, and of one operation on it, both with room.
_ERROR, _ROUND = np.float64(5e-7), np.float64(1.2e-7)


def _least(q: np.ndarray, t: np.ndarray, name: str, params: dict, skip: np.ndarray, wider: dict | None = None, both: np.ndarray | None = None) -> np.ndarray | None:
    """Distances that may be a query's least, exactly; the others are infinite.  None where there is no rough distance.

    Squared direct distances come from one matrix product, other direct and banded warping ones from 32 bits; an exact kernel call
    then takes all pairs that the error of the rough distance leaves.  wider keeps the least that warping distances can be, by
    exponent: they are no greater in a wider window, so those of the widest, which comes first, serve the others.  Its `sums`, if
    any, bound direct distances of the exponents from 0.5 to 2.  both has what the least of each of t is at most, and takes what is
    found here: distances that may be the least of one of t are exact then, too.
    """
    direct = name == "directa" or name == "dtw" and params.get("window") == 0
    wider, cfe = {} if wider is None else wider, params.get("cfe", 2.0)
    out = np.full(skip.shape, np.inf)

    def exact(row: np.ndarray, col: np.ndarray) -> None:
        for lo in range(0, len(row), 4096):
            i, j = row[lo:lo + 4096], col[lo:lo + 4096]
            out[i, j] = K.DISTANCES[name](q[i], t[j], **params)

    if name == "dtw" and cfe in wider and not (direct and cfe == 2.0):
        low = wider[cfe]
        some = np.argpartition(low, min(FEW, low.shape[1]) - 1, axis=1)[:, :FEW]  # likely near
        exact(np.repeat(np.arange(len(low)), some.shape[1]), some.ravel())
        if both is not None and np.isinf(both).any():
            some = np.argpartition(low, min(FEW, len(low)) - 1, axis=0)[:FEW]
            exact(some.ravel(), np.tile(np.arange(low.shape[1]), len(some)))
        out[skip] = np.inf
        may = low <= out.min(axis=1, keepdims=True)
        if both is not None:
            may |= low <= np.minimum(both, out.min(axis=0), out=both)
        exact(*np.nonzero(may & np.isinf(out)))
        if both is not None:
            np.minimum(both, out.min(axis=0), out=both)
        return out
    rough = _product(q, t) if direct and cfe == 2.0 else _from_sums(wider["sums"], cfe) if wider.get("sums") and 0.5 <= cfe < 2 else _rough(q, t, name, params)
    if rough is None:
        return None
    _, low, high = rough
    low[skip] = high[skip] = np.inf
    unit = 1.0
    if name == "dtw" and not (direct and cfe == 2.0):
        with np.errstate(over="ignore", under="ignore"):
            unit = max(np.abs(q).max(), np.abs(t).max()) ** cfe * (1 - 1e-9)  # rough distances are of values scaled to at most 1
        if not direct and 1e-200 < unit < 1e200:
            wider[cfe] = low * unit
    may = low <= high.min(axis=1, keepdims=True)
    if both is not None:
        known = high.min(axis=0)
        if 1e-200 < unit < 1e200:
            known = np.minimum(known, both / unit)
        may |= low <= known
    row, col = np.nonzero(may)
    if wider.get("sums") and name == "directa" and cfe not in wider["sums"] and 0.5 < cfe < 2:
        row, col = _again(q, t, cfe, row, col)
    exact(row, col)
    if both is not None:
        np.minimum(both, out.min(axis=0), out=both)
    return out


def _product(q: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    qq, tt = (q * q).sum(axis=1)[:, None], (t * t).sum(axis=1)[None, :]
    d = qq + tt - 2 * (q @ t.T)
    return (d, d - 1e-9 * (qq + tt), d.copy()) if np.isfinite(d).all() else None


def _rough(q: np.ndarray, t: np.ndarray, name: str, params: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(distances in 32 bits of values scaled to at most 1, the least and the most that the exact ones can be)."""
    cfe, length = params.get("cfe", 2.0), q.shape[1]
    most = max(np.abs(q).max(initial=0.0), np.abs(t).max(initial=0.0))
    if name not in ("directa", "dtw") or not length or not cfe > 0 or not np.isfinite(most) or not 1e-100 < most < 1e100 or set(params) - {"cfe", "window"}:
        return None
    a, b = np.ascontiguousarray((q / most).T.astype(np.float32)), np.ascontiguousarray((t / most).T.astype(np.float32))
    cost, steps = _cost(cfe), length if name == "directa" else 2 * length
    d = np.empty((len(q), len(t)), np.float32)
    if name == "directa":
        for lo in range(0, len(q), 64):
            part = np.zeros_like(d[lo:lo + 64])
            for x, y in zip(a[:, lo:lo + 64], b):
                part += cost(x[:, None] - y[None, :])
            d[lo:lo + 64] = part
    else:
        width = max(1, 8192 // len(t))
        for lo in range(0, len(q), width):
            d[lo:lo + width] = _warped(a[:, lo:lo + width], b, cost, params.get("window"))
    if not np.isfinite(d).all():
        return None
    return _margins(d, cfe, steps)


def _margins(d: np.ndarray, cfe: float, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    point = _ERROR ** cfe if cfe < 1 else cfe * 2.1 ** (cfe - 1) * _ERROR  # most error of a point's cost
    off, share = steps * point, (steps + 20 * cfe + 20) * _ROUND
    d = d.astype(float)
    return d, d * (1 - share) - off, d * (1 + share) + off


def _sums(q: np.ndarray, t: np.ndarray) -> dict | None:
    """exponent -> (rough, least, most) direct distance of values scaled to at most 1, for 0.5, 1 and 1.5 in one pass, and 2."""
    most = max(np.abs(q).max(initial=0.0), np.abs(t).max(initial=0.0))
    if not q.shape[1] or not np.isfinite(most) or not 1e-100 < most < 1e100:
        return None
    a, b = np.ascontiguousarray((q / most).T.astype(np.float32)), np.ascontiguousarray((t / most).T.astype(np.float32))
    found = {e: np.zeros((len(q), len(t)), np.float32) for e in (0.5, 1.0, 1.5)}
    width = max(1, 16384 // len(t))
    for lo in range(0, len(q), width):
        half, one, more = (d[lo:lo + width] for d in found.values())
        c, root = np.empty_like(one), np.empty_like(one)
        for x, y in zip(a[:, lo:lo + width], b):
            np.subtract(x[:, None], y[None, :], out=c)
            one += np.abs(c, out=c)
            half += np.sqrt(c, out=root)
            more += np.multiply(c, root, out=c)
    d, low, _ = _product(q / most, t / most)
    return {e: _margins(d, e, q.shape[1]) for e, d in found.items()} | {2.0: (d, low, 2 * d - low)}


def _from_sums(sums: dict, cfe: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rough, least, most) direct distance of an exponent from 0.5 to 2: sums of powers are log-convex in the exponent.

    Between two known exponents the sum is at most their geometric mean; and it is at least what makes the known one beside it
    the mean of it and the next one on that side.
    """
    if cfe in sums:
        return tuple(x.copy() for x in sums[cfe])
    known = sorted(sums)
    up = next(i for i, e in enumerate(known) if e > cfe)
    least = lambda e: np.maximum(sums[e][1], 0.0)
    most = lambda e: np.maximum(sums[e][2], 1e-30)
    share = (cfe - known[up - 1]) / (known[up] - known[up - 1])
    high, low = most(known[up - 1]) ** (1 - share) * most(known[up]) ** share * (1 + 1e-9), np.zeros(least(1.0).shape)
    for beside, beyond in ((up, up + 1), (up - 1, up - 2)):
        if 0 <= beyond < len(known):
            share = (known[beside] - cfe) / (known[beyond] - cfe)
            low = np.maximum(low, (least(known[beside]) / most(known[beyond]) ** share) ** (1 / (1 - share)) * (1 - 1e-9))
    return high, low, high.copy()


def _again(q: np.ndarray, t: np.ndarray, cfe: float, row: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs those that may be a query's least by their own powers in 32 bits."""
    most = max(np.abs(q).max(), np.abs(t).max())
    a, b, cost, d = (q / most).astype(np.float32), (t / most).astype(np.float32), _cost(cfe), np.empty(len(row), np.float32)
    for lo in range(0, len(row), 1024):
        d[lo:lo + 1024] = cost(a[row[lo:lo + 1024]] - b[col[lo:lo + 1024]]).sum(axis=1)
    _, low, high = _margins(d, cfe, q.shape[1])
    least = np.full(len(q), np.inf)
    np.minimum.at(least, row, high)
    left = low <= least[row]
    return row[left], col[left]


def _cost(cfe: float):
    """|x| ** cfe in place."""
    def run(x: np.ndarray) -> np.ndarray:
        if cfe == 2:
            return np.multiply(x, x, out=x)
        np.abs(x, out=x)
        if cfe == 0.5:
            return np.sqrt(x, out=x)
        if cfe == 1.5:
            x *= np.sqrt(x)
        elif cfe != 1:
            with np.errstate(divide="ignore"):
                np.log(x, out=x)
            x *= np.float32(cfe)
            np.exp(x, out=x)
        return x
    return run


def _warped(a: np.ndarray, b: np.ndarray, cost, window: int | None) -> np.ndarray:
    """kernels.dtw of all pairs of a (points, queries) and b (points, series), one anti-diagonal after the other.

    Only the band is kept, in place: `same` has the cells whose i - j is w, w - 2, .., -w, `other` those between, with infinity at both
    ends.  A cell's diagonal neighbour is where it is written, the two others are beside it in the other array.
    """
    n, shape = len(a), (a.shape[1], b.shape[1])
    w = n - 1 if window is None else min(window, n - 1)
    same, other, costs = (np.full((rows, *shape), np.inf, np.float32) for rows in (w + 1, w + 2, w + 1))
    last = (other[(w + 1) // 2] if w % 2 else same[w // 2])  # where i = j
    last[:] = 0.0
    back = b[::-1]
    for s in range(1, 2 * n + 1):
        lo, hi = max(1, s - n, -(-(s - w) // 2)), min(n, s - 1, (s + w) // 2)
        if lo > hi:
            continue
        c, odd = costs[:hi - lo + 1], (s - w) % 2
        np.subtract(a[lo - 1:hi, :, None], back[n - s + lo:n - s + hi + 1, None, :], out=c)
        cost(c)
        at = (2 * lo - s + w + odd) // 2
        to = at + hi - lo + 1
        cells, first, second = (other[at:to], same[at - 1:to - 1], same[at:to]) if odd else (same[at:to], other[at:to], other[at + 1:to + 1])
        np.minimum(cells, first, out=cells)
        np.minimum(cells, second, out=cells)
        cells += c
    return last


def _matrix(block: list) -> np.ndarray | None:
    """Values of a block; None if lengths differ."""
    return np.array([s["values"] for s in block], float).reshape(len(block), -1) if len({len(s["values"]) for s in block}) == 1 else None


def _widest_first(params: dict) -> float:
    return -np.inf if params.get("window") is None else -params["window"]


def _between(q: list, t: list, name: str, params: dict, exclude_self: bool) -> Iterator[tuple[list, np.ndarray]]:
    return ((part, d) for _, part, d in _between_all(q, t, name, [params], exclude_self))


def _between_all(q: list, t: list, name: str, grid: list[dict], exclude_self: bool, matrices: tuple | None = None, both: bool = False) -> Iterator[tuple[int, list, np.ndarray]]:
    """Places in the grid and slices of q with their distances to all of t, NaN where a series meets itself.  What is not a least may be infinite.

    both: the leasts of t over all slices are exact, too.
    """
    found = [np.full(len(t), np.inf) if both else None for _ in grid]
    qv, tv = matrices or (_matrix(q), _matrix(t))
    tid, qid = np.array([s["series_id"] for s in t]), np.array([s["series_id"] for s in q])
    even = qv is not None and tv is not None and qv.shape[1] == tv.shape[1]
    for lo in range(0, len(q), SLICE):
        part = q[lo:lo + SLICE]
        skip = qid[lo:lo + SLICE, None] == tid[None, :] if exclude_self else np.zeros((len(part), len(t)), bool)
        wider: dict = {}
        if even and name == "directa" and any(0.5 < params.get("cfe", 2.0) < 1 for params in grid):  # powers of 32-bit values are slow
            wider["sums"] = _sums(qv[lo:lo + SLICE], tv)
        for p, params in sorted(enumerate(grid), key=lambda g: _widest_first(g[1])):
            d = _least(qv[lo:lo + SLICE], tv, name, params, skip, wider, found[p]) if even else None
            if d is None:
                d = np.empty(skip.shape)
                step = max(1, 4096 // len(t))
                for at in range(0, len(part), step):
                    some = part[at:at + step]
                    if even:
                        made = K.DISTANCES[name](np.repeat(qv[lo + at:lo + at + len(some)], len(t), axis=0), np.tile(tv, (len(some), 1)), **params)
                    else:
                        made = rows_distance(name, [s["values"] for s in some for _ in t], [s["values"] for s in t] * len(some), params)
                    d[at:at + step] = made.reshape(len(some), len(t))
            d[skip] = np.nan
            yield p, part, d


def _block_pairs(queries: DataFrame, train: DataFrame, once: bool = False) -> DataFrame:
    """once: of two tables that are the same, each pair of blocks in one order only."""
    met = F.col("q_block") <= F.col("t_block") if once else F.lit(True)
    return _blocks(queries, "q").join(_blocks(train, "t"), met).repartition("q_block", "t_block").select("q", "t", (F.col("q_block") < F.col("t_block")).alias("differ"))  # a block is one row


def _first_least(d: np.ndarray, axis: int) -> np.ndarray:
    """Places of the least numbers: the first of equal ones, never a NaN beside an infinite distance."""
    real = ~np.isnan(d)
    known = np.where(real, d, np.inf)
    return np.where(np.isinf(known.min(axis=axis)), real.argmax(axis=axis), known.argmin(axis=axis))


class _Nearest:
    """The least distance of each of t over slices of queries, the least id of equal ones: slices come in id order."""

    def __init__(self, n: int):
        self.d, self.at, self.met = np.full(n, np.inf), np.zeros(n, int), np.zeros(n, bool)

    def add(self, d: np.ndarray, first: int) -> None:
        k = _first_least(d, 0)
        least = d[k, np.arange(len(k))]
        real = ~np.isnan(least)
        less = real & ((least < self.d) | ~self.met)
        self.d[less], self.at[less] = least[less], first + k[less]
        self.met |= real


def nearest(queries: DataFrame, train: DataFrame, name: str = "directa", grid: list[dict] | None = None, exclude_self: bool = False) -> DataFrame:
    """(series_id, label, param, nn_dist, nn_id, nn_label): ties go to the least id.  grid: parameter sets, param is the index;
    sets that repeat are computed once.  Warping distances are the same both ways: where queries and train are one table, a pair of
    blocks is met once, for the queries of both."""
    grid = grid or [{}]
    once = queries is train and name == "dtw"
    places = defaultdict(list)
    for p, params in enumerate(grid):
        places[tuple(sorted(params.items()))].append(p)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for q, t, differ in zip(batch["q"], batch["t"], batch["differ"]):
                q, t = (sorted(block, key=lambda s: s["series_id"]) for block in (q, t))
                matrices, tid, tlabel = (_matrix(q), _matrix(t)), np.array([s["series_id"] for s in t]), np.array([s["label"] for s in t], object)
                back = [_Nearest(len(t)) for _ in places] if once and differ else None
                seen = [0] * len(places)
                for one_of, part, d in _between_all(q, t, name, [dict(params) for params in places], exclude_self, matrices, back is not None):
                    if back:
                        back[one_of].add(d, seen[one_of])
                        seen[one_of] += len(part)
                    some = np.nonzero(~np.isnan(d).all(axis=1))[0]
                    if len(some):
                        k = _first_least(d[some], 1)
                        one = pd.DataFrame({"series_id": [part[i]["series_id"] for i in some], "label": [part[i]["label"] for i in some], "param": 0, "nn_dist": d[some, k], "nn_id": tid[k], "nn_label": tlabel[k]})
                        for p in list(places.values())[one_of]:
                            yield one.assign(param=p)
                for near, of in zip(back or (), places.values()):
                    some = np.nonzero(near.met)[0]
                    at = near.at[some]
                    one = pd.DataFrame({"series_id": tid[some], "label": tlabel[some], "param": 0, "nn_dist": near.d[some], "nn_id": [q[i]["series_id"] for i in at], "nn_label": [q[i]["label"] for i in at]})
                    for p in of:
                        yield one.assign(param=p)

    best = _block_pairs(queries, train, once).mapInPandas(run, "series_id long, label string, param int, nn_dist double, nn_id long, nn_label string")
    return best.groupBy("series_id", "label", "param").agg(F.min(F.struct("nn_dist", "nn_id", "nn_label")).alias("n")).select("series_id", "label", "param", "n.*")


def nearest_counts(queries: DataFrame, train: DataFrame, name: str = "directa", params: dict | None = None, exclude_self: bool = False) -> DataFrame:
    """(series_id, label, nn_dist, nn_label, n): how many of the equally near series each class has.

    A block pair sends the classes of its own nearest only; a query has at most one row for each class and block of train.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for q, t in zip(batch["q"], batch["t"]):
                out = []
                for part, d in _between(list(q), list(t), name, params or {}, exclude_self):
                    for s, row in zip(part, d):
                        if not np.isnan(row).all():
                            least = np.nanmin(row)
                            for label, n in Counter(t[k]["label"] for k in np.nonzero(row == least)[0]).items():
                                out.append((s["series_id"], s["label"], float(least), label, n))
                yield pd.DataFrame(out, columns=["series_id", "label", "nn_dist", "nn_label", "n"])

    found = _block_pairs(queries, train).select("q", "t").mapInPandas(run, "series_id long, label string, nn_dist double, nn_label string, n long")
    counts = found.groupBy("series_id", "label", "nn_dist", "nn_label").agg(F.sum("n").alias("n"))
    least = F.min("nn_dist").over(Window.partitionBy("series_id"))
    return counts.withColumn("least", least).where("nn_dist = least").drop("least")


def vote_of_ties(counts: DataFrame) -> DataFrame:
    """(series_id, label, predicted, correct) from nearest_counts: the class with most, the least label on ties."""
    most = counts.groupBy("series_id", "label").agg(F.min(F.struct((-F.col("n")).alias("m"), "nn_label")).alias("v"))
    return most.select("series_id", "label", F.col("v.nn_label").alias("predicted"), F.col("v.nn_label").eqNullSafe(F.col("label")).alias("correct"))


def nearest_pruned(queries: DataFrame, train: DataFrame, window: int, cfe: float = 2.0, exclude_self: bool = False) -> DataFrame:
    """nearest() under banded DTW: rough distances in 32 bits leave few candidates, whose exact distances decide."""
    return nearest(queries, train, "dtw", [{"cfe": cfe, "window": window}], exclude_self)


def loocv(train: DataFrame, name: str, grid: list[dict], sample: DataFrame | None = None) -> DataFrame:
    """(param, errors, best): leave-one-out errors of each parameter set, and whether it is among the best.

    sample(series_id): score these series only, against all of train.
    """
    queries = train if sample is None else train.join(sample.select("series_id"), "series_id", "left_semi")
    found = nearest(queries, train, name, grid, exclude_self=True)
    errors = found.groupBy("param").agg(F.sum((~F.col("nn_label").eqNullSafe(F.col("label"))).cast("long")).alias("errors"))
    least = errors.agg(F.min("errors").alias("least"))
    return errors.join(F.broadcast(least), F.lit(True)).select("param", "errors", (F.col("errors") == F.col("least")).alias("best"))  # one row


def classify(queries: DataFrame, train: DataFrame, name: str, params: dict, exclude_self: bool = False) -> DataFrame:
    """(series_id, label, predicted, correct)."""
    found = nearest(queries, train, name, [params], exclude_self)
    return found.select("series_id", "label", F.col("nn_label").alias("predicted"), F.col("nn_label").eqNullSafe(F.col("label")).alias("correct"))


def accuracy(predictions: DataFrame) -> DataFrame:
    return predictions.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("correct").cast("long")).alias("n_correct"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


def majority_vote(votes: DataFrame) -> DataFrame:
    """votes(series_id, label) -> (series_id, label, n): most votes, the least label on ties."""
    n = votes.groupBy("series_id", "label").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("series_id").agg(F.max(F.struct("n", F.struct(-F.col("n")).alias("x"))).alias("m"), F.collect_list(F.struct("n", "label")).alias("all")).select(
        "series_id", F.array_min(F.transform(F.filter("all", lambda e: e["n"] == F.col("m.n")), lambda e: e["label"])).alias("label"), F.col("m.n").alias("n"))


def weighted_average(results: DataFrame) -> DataFrame:
    """results(series_id, probabilities, weight) -> weighted mean probabilities."""
    p = results.select("series_id", "weight", F.posexplode("probabilities").alias("k", "p"))
    mean = p.groupBy("series_id", "k").agg((F.sum(F.col("p") * F.col("weight")) / F.sum("weight")).alias("p"))
    return mean.groupBy("series_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "p"))), lambda e: e["p"]).alias("probabilities"))
