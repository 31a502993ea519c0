"""The 1-NN suite against plain loops."""

import numpy as np
import pytest
from conftest import DATA, rows
from pyspark.sql import functions as F

from seriesforge.functions import kernels as K
from seriesforge.operators import dataset as D
from seriesforge.operators import forest, neighbours as N, suite
from seriesforge.plans import grids

SCHEMA = "series_id long, label string, values array<double>"


def _plain(queries, train, distance, exclude_self=False):
    """series_id -> (least distance, {label: how many})."""
    out = {}
    for i, _, v in queries:
        near = [(distance(v, w), label) for j, label, w in train if not (exclude_self and i == j)]
        if near:
            least = min(d for d, _ in near)
            labels = [label for d, label in near if d == least]
            out[i] = (least, {x: labels.count(x) for x in labels})
    return out


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(5)
    values = rng.integers(0, 3, (700, 3)).astype(float)  # many are equally near, over two blocks
    return [(i, None if i % 50 == 0 else "abc"[i % 3], v.tolist()) for i, v in enumerate(values)]


@pytest.mark.parametrize("cfe", [2.0, 1.0])
def test_counts_among_ties(spark, points, cfe):
    series = spark.createDataFrame(points, SCHEMA)
    found = {}
    for r in N.nearest_counts(series, series, "directa", {"cfe": cfe}, exclude_self=True).collect():
        found.setdefault(r["series_id"], (r["nn_dist"], {}))[1][r["nn_label"]] = r["n"]
    assert found == _plain(points, points, lambda v, w: float(sum(abs(x - y) ** cfe for x, y in zip(v, w))), True)


def test_matrix_product_keeps_the_exact_nearest(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(60, 16)) * 1e3
    values = np.concatenate([base, base + rng.normal(size=base.shape) * 1e-9, base])  # differences far below the product's error
    data = [(i, "a", v.tolist()) for i, v in enumerate(values)]
    got = {r["series_id"]: (r["nn_id"], r["nn_dist"]) for r in N.nearest(spark.createDataFrame(data, SCHEMA), spark.createDataFrame(data, SCHEMA), exclude_self=True).collect()}
    for i, v in enumerate(values):
        d = K.directa(np.broadcast_to(v, values.shape), values)
        d[i] = np.inf
        assert got[i] == (int(d.argmin()), float(d.min()))


def test_odd_tables(spark):
    one = spark.createDataFrame([(1, "a", [1.0, 2.0])], SCHEMA)
    none = one.limit(0)
    odd = spark.createDataFrame([(1, "a", [1.0, 2.0]), (2, None, []), (3, "b", [float("nan"), 1.0]), (4, "b", [1.0, 2.0, 3.0])], SCHEMA)
    assert N.nearest(one, one, exclude_self=True).count() == 0 and N.nearest_counts(none, one).count() == 0 and N.nearest(one, none).count() == 0
    assert {r["series_id"]: (r["nn_id"], r["nn_dist"]) for r in N.nearest(odd, one).collect()} == {1: (1, 0.0), 2: (1, float("inf")), 4: (1, float("inf"))}
    assert suite.search(one, none, "ED1NN")[2].count() == 0
    assert suite.direct_cost(one, [2.0], 10).collect() == [(2.0, 0.0)]


def test_repeated_parameter_sets_count_once_and_keep_their_place(spark):
    series = D.embedding_series(spark, DATA).where("series_id < 60")
    grid = [{"window": 1}, {"window": 0}, {"window": 1}]
    found = N.nearest(series, series, "dtw", grid, exclude_self=True)
    single = {p: rows(N.nearest(series, series, "dtw", [g], exclude_self=True).drop("param")) for p, g in enumerate(grid)}
    for p in range(3):
        assert rows(found.where(F.col("param") == p).drop("param")) == single[p]


@pytest.mark.parametrize("name", ["CDTW1NN", "CDTW+1NN", "ADTW1NN", "ADTW+1NN-0.5", "LCSS1NN", "Minkowski1NN-1.0", "d2-CDTW1NN-0.5"])
def test_search_takes_the_first_best(spark, name):
    """Every third set of the classifier's own grid, against one matrix of distances for each set."""
    series = suite.transformed(D.embedding_series(spark, DATA).where("series_id < 48"), "default")
    train, test = series.where("series_id % 2 = 0"), series.where("series_id % 2 = 1")
    named = grids.by_name(name)
    of = lambda df: suite.transformed(df, named["transform"]).orderBy("series_id").collect()
    a, b = of(train), of(test)
    grid = suite.grid_of(suite.transformed(train, named["transform"]), named, 50)
    assert len(grid) == {"CDTW": 100, "CDTW+": 500, "ADTW": 100, "ADTW+": 100, "LCSS": 100, "Minkowski": 1}[named["family"]]
    grid = grid[::3] if len(grid) < 200 else grid[::60]
    best, params, found = suite.search(train, test, name, grid)
    matrix = lambda p, q, g: np.array([N.rows_distance(named["distance"], [r["values"]] * len(q), [s["values"] for s in q], g) for r in p])
    errors = []
    for g in grid:
        d = matrix(a, a, g)
        np.fill_diagonal(d, np.inf)
        errors.append(sum(a[k]["label"] != r["label"] for k, r in zip(d.argmin(axis=1), a)))
    assert best == int(np.argmin(errors)) and params == grid[best]
    expect = set()
    for r, d in zip(b, matrix(b, a, params)):
        near = [a[k]["label"] for k in np.nonzero(d == d.min())[0]]
        expect.add((r["series_id"], min(near, key=lambda x: (-near.count(x), x))))
    assert {(r["series_id"], r["predicted"]) for r in found.collect()} == expect


def test_forest_stops_and_majority_vote(spark):
    series = D.embedding_series(spark, DATA).where("series_id < 60")
    codes = D.encode_labels(series)
    stump = forest.fit(series, codes, 2, 1, "DA", adtw_pairs=10, min_gini=1.0)
    assert [r["nodes"] for r in stump.collect()] == [1, 1]
    model = forest.fit(series, codes, 5, 1, "DA", adtw_pairs=10, stop_on_empty=True)
    of_tree = {}
    for r in forest.votes(model, series).collect():
        of_tree.setdefault(r["series_id"], []).append(int(np.argmax(r["probabilities"])))
    for r in forest.predict(model, series, "majority").collect():
        v = of_tree[r["series_id"]]
        assert r["predicted"] == min(set(v), key=lambda c: (-v.count(c), c)) and sum(r["probabilities"]) == pytest.approx(1.0)
    with pytest.raises(ValueError, match="vote"):
        forest.predict(model, series, "best")


def _leasts(monkeypatch, name, params, q, t):
    """Least distances by _between, of _plain numpy, and the share of pairs that the exact kernel took."""
    taken, kernel = [], K.DISTANCES[name]
    monkeypatch.setitem(K.DISTANCES, name, lambda a, b, **p: taken.append(len(a)) or kernel(a, b, **p))
    block = lambda x, at: [{"series_id": at + i, "label": "a", "values": v} for i, v in enumerate(x)]
    got = np.concatenate([d for _, d in N._between(block(q, 0), block(t, 7), name, params, True)])
    want = kernel(np.repeat(q, len(t), axis=0), np.tile(t, (len(q), 1)), **params).reshape(len(q), len(t))
    same = np.arange(len(q))[:, None] == 7 + np.arange(len(t))[None, :]
    want[same] = np.nan
    assert (np.isnan(got) == np.isnan(want)).all()
    got, want = np.where(np.isnan(got), np.inf, got), np.where(np.isnan(want), np.inf, want)
    least = want.min(axis=1, keepdims=True)
    assert (got.min(axis=1, keepdims=True) == least).all() and ((got == least) == (want == least)).all()
    return sum(taken) / want.size


def _sets(params):
    return [{"window": w, "cfe": e} for w in params for e in (2.0, 1.0, 0.5)]


@pytest.mark.parametrize("name,params", [("dtw", p) for p in _sets((3, None))])
def test_banded_search_takes_few_exact_distances(monkeypatch, name, params):
    rng = np.random.default_rng(3)
    assert _leasts(monkeypatch, name, params, rng.normal(size=(90, 40)), rng.normal(size=(110, 40))) < 0.05
    for q in (rng.integers(0, 2, (60, 5)).astype(float), np.zeros((5, 4)), 1e-120 * rng.normal(size=(9, 6)), 1e200 * rng.normal(size=(9, 6)), rng.normal(size=(20, 1)) * 1e30):
        _leasts(monkeypatch, name, params, q, np.concatenate([q, -q]))


@pytest.mark.parametrize("window", [0, 2, 4])
def test_windows_of_loocv_take_few_exact_distances(monkeypatch, window):
    rng = np.random.default_rng(4)
    assert _leasts(monkeypatch, "dtw", {"window": window}, rng.normal(size=(90, 64)), rng.normal(size=(110, 64))) < 0.05


@pytest.mark.parametrize("cfe", [1.0, 1.5, 0.666666, 2.0, 0.5, 3.0])
def test_direct_search_takes_few_exact_distances(monkeypatch, cfe):
    rng = np.random.default_rng(5)
    assert _leasts(monkeypatch, "directa", {"cfe": cfe}, rng.normal(size=(300, 40)), rng.normal(size=(310, 40))) < 0.05
    for q in (rng.integers(0, 2, (60, 5)).astype(float), np.zeros((5, 4)), 1e-120 * rng.normal(size=(9, 6)), rng.normal(size=(20, 1)) * 1e30):
        _leasts(monkeypatch, "directa", {"cfe": cfe}, q, np.concatenate([q, -q]))


def test_narrower_windows_are_screened_by_the_widest(monkeypatch):
    """One search in 32 bits for all windows of an exponent, few exact distances, the plain loop's leasts; also of large and of tiny values."""
    rng, calls, rough = np.random.default_rng(5), [], []
    warped, dtw = N._warped, K.dtw
    monkeypatch.setattr(N, "_warped", lambda *a: rough.append(a[3]) or warped(*a))
    monkeypatch.setitem(K.DISTANCES, "dtw", lambda a, b, **p: calls.append(len(a)) or dtw(a, b, **p))
    grid = [{"window": w} for w in (0, 2, 4, 3)] + [{"cfe": 1.0, "window": w} for w in (1, 5)]
    for scale in (1.0, 1e3, 1e-3):
        q, t = rng.normal(size=(60, 32)) * scale, rng.normal(size=(110, 32)) * scale
        t[5] = q[5]
        block = lambda x, at: [{"series_id": at + i, "label": "a", "values": list(v)} for i, v in enumerate(x)]
        calls.clear(), rough.clear()
        got = {p: d for p, _, d in N._between_all(block(q, 0), block(t, 7), "dtw", grid, True)}
        assert set(rough) == {4, 5} and sum(calls) < 0.25 * len(grid) * 60 * 110
        for p, params in enumerate(grid):
            want = dtw(np.repeat(q, 110, axis=0), np.tile(t, (60, 1)), **params).reshape(60, 110)
            want[np.arange(60)[:, None] == 7 + np.arange(110)[None, :]] = np.nan
            assert (np.nanmin(got[p], axis=1) == np.nanmin(want, axis=1)).all() and (np.nanargmin(got[p], axis=1) == np.nanargmin(want, axis=1)).all()


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_band_in_place(n):
    rng = np.random.default_rng(n)
    q, t = rng.normal(size=(5, n)), rng.normal(size=(9, n))
    for window in (0, 1, 2, 5, n, 100, None):
        got = N._warped(q.T.astype(np.float32), t.T.astype(np.float32), N._cost(1.0), window)
        assert np.allclose(got, K.dtw(np.repeat(q, 9, axis=0), np.tile(t, (5, 1)), 1.0, window).reshape(5, 9), rtol=1e-4)


def test_exponents_share_one_pass(monkeypatch):
    """No search of its own for any exponent of the grid, few exact distances, the plain loop's leasts; also of copies and of other scales."""
    rng, calls, directa = np.random.default_rng(11), [], K.directa
    monkeypatch.setattr(N, "_rough", lambda *a: pytest.fail("a pass of its own"))
    monkeypatch.setitem(K.DISTANCES, "directa", lambda a, b, **p: calls.append(len(a)) or directa(a, b, **p))
    grid = grids.minkowski_grid() + [{"cfe": 0.6}, {"cfe": 1.9}]
    for scale in (1.0, 1e3, 1e-6):
        q = rng.normal(size=(300, 40)) * scale
        t = np.concatenate([rng.normal(size=(300, 40)) * scale, q[:5], q[:3], np.zeros((2, 40))])
        q[7] = 0
        block = lambda x, at: [{"series_id": at + i, "label": "a", "values": list(v)} for i, v in enumerate(x)]
        calls.clear()
        for p, part, d in N._between_all(block(q, 0), block(t, 7), "directa", grid, True):
            lo = part[0]["series_id"]
            want = np.stack([directa(np.broadcast_to(v, t.shape), t, grid[p]["cfe"]) for v in q[lo:lo + len(part)]])
            want[np.arange(lo, lo + len(part))[:, None] == 7 + np.arange(len(t))[None, :]] = np.nan
            assert (np.nanmin(d, axis=1) == np.nanmin(want, axis=1)).all() and (np.nanargmin(d, axis=1) == np.nanargmin(want, axis=1)).all()
        assert sum(calls) < 0.15 * len(grid) * len(q) * len(t)
