"""A table searched in itself under warping distances: every series is scored, every pair of blocks is met once."""

import numpy as np
import pytest
from conftest import DATA, rows

from seriesforge import catalog
from seriesforge.functions import kernels as K
from seriesforge.operators import dataset as D, neighbours as N

SCHEMA = "series_id long, label string, values array<double>"


def test_loocv_cdtw_scores_every_series(spark):
    series = D.embedding_series(spark, DATA).orderBy("series_id").collect()
    x, labels = np.array([r["values"] for r in series]), np.array([r["label"] for r in series])
    errors = []
    for window in (0, 2, 4):
        d = np.array([K.dtw(np.broadcast_to(v, x.shape), x, window=window) for v in x])
        np.fill_diagonal(d, np.inf)
        errors.append(int((labels[d.argmin(axis=1)] != labels).sum()))
    got = catalog.QUERIES["loocv_cdtw"](spark, DATA).orderBy("param").collect()
    assert [(r["param"], r["errors"], r["best"]) for r in got] == [(p, e, e == min(errors)) for p, e in enumerate(errors)]


def _tables():
    rng = np.random.default_rng(12)
    odd = [[], [float("nan"), 1.0, 2.0, 0.0], [1.0, 2.0], [float("inf"), 0.0, 0.0, 1.0], [0.0] * 4]
    yield "ties", rng.integers(0, 2, (700, 4)).astype(float).tolist()
    yield "far apart", rng.normal(size=(600, 12)).tolist()
    yield "scales", (rng.normal(size=(600, 12)) * 10.0 ** rng.integers(-3, 4, (600, 1))).tolist()
    yield "odd", rng.normal(size=(300, 4)).tolist() + odd


@pytest.mark.parametrize("name,values", list(_tables()), ids=lambda x: x if isinstance(x, str) else "")
def test_pairs_met_once_give_the_same_nearest(spark, monkeypatch, name, values):
    """Two windows and two exponents, with and without the series itself, against the search of two tables."""
    series = spark.createDataFrame([(3 * i, None if i % 50 == 0 else "abc"[i % 3], v) for i, v in enumerate(values)], SCHEMA)
    grid = [{"window": 0}, {"window": 3}, {"cfe": 1.0, "window": 1}, {"cfe": 0.5}]
    for itself in (True, False):
        assert rows(N.nearest(series, series, "dtw", grid, itself)) == rows(N.nearest(series, series.select("*"), "dtw", grid, itself))


def test_pairs_of_blocks_are_met_once(spark):
    series = D.embedding_series(spark, DATA)
    assert N._blocks(series, "q").count() == 8
    assert N._block_pairs(series, series, True).count() == 36 and N._block_pairs(series, series).count() == 64


def test_both_ways_take_few_exact_distances(monkeypatch):
    rng, calls, dtw = np.random.default_rng(13), [], K.dtw
    monkeypatch.setitem(K.DISTANCES, "dtw", lambda a, b, **p: calls.append(len(a)) or dtw(a, b, **p))
    q, t = rng.normal(size=(600, 64)), rng.normal(size=(500, 64))
    block = lambda x, at: [{"series_id": at + i, "label": "a", "values": list(v)} for i, v in enumerate(x)]
    near = N._Nearest(500)
    for n, (_, _, d) in enumerate(N._between_all(block(q, 0), block(t, 600), "dtw", [{"window": 3}], True, both=True)):
        near.add(d, n * N.SLICE)
    assert sum(calls) < 0.05 * 600 * 500
    want = np.stack([dtw(np.broadcast_to(v, t.shape), t, window=3) for v in q])
    assert (near.d == want.min(axis=0)).all() and (near.at == want.argmin(axis=0)).all()


def test_nn1_cdtw_searches_one_table(spark, monkeypatch):
    seen, run = [], N.nearest
    monkeypatch.setattr(N, "nearest", lambda queries, train, *a, **o: seen.append(queries is train) or run(queries, train, *a, **o))
    assert catalog.QUERIES["nn1_cdtw"](spark, DATA).count() == 500 and seen == [True]
