"""What lets a forest grow on large tables: rough distances first, trees and features that are small, trees grown once."""

import json

import numpy as np
import pytest
from conftest import DATA

from seriesforge.functions import kernels as K
from seriesforge.functions import rough as R
from seriesforge.operators import dataset as D, forest

OPTIONS = {"adtw_pairs": 20, "hydra_groups": 4, "candidates": 2, "max_depth": 64, "min_size": 1, "smooth": False, "try_all": False, "min_gini": 0.0, "stop_on_empty": False}


@pytest.mark.parametrize("n", [1, 2, 13, 64])
@pytest.mark.parametrize("scale", [0.125, 1e3])
def test_bounds_hold_the_exact_distance(n, scale):
    """for every elastic distance, one parameter or one a pair; LCSS is exact."""
    rng, pairs = np.random.default_rng(n), 120
    each = lambda lo, hi: rng.uniform(lo, hi, pairs) * scale
    sets = [("dtw", {"cfe": c} | w) for c in (0.5, 1.0, 2.0) for w in ({}, {"window": 0}, {"window": 1}, {"window": 16})]
    sets += [("adtw", {"cfe": c, "penalty": q}) for c in (0.5, 1.0, 2.0) for q in (0.0, each(0, 1))] + [("wdtw", {"cfe": 2.0, "g": g}) for g in (0.1, rng.random(pairs))]
    sets += [("lcss", {"epsilon": q} | w) for q in (0.3 * scale, each(0, 1)) for w in ({}, {"window": 0}, {"window": 7})]
    sets += [("erp", {"cfe": 2.0, "gap": q} | w) for q in (0.3 * scale, each(0.1, 1)) for w in ({}, {"window": 0}, {"window": 5})]
    sets += [("msm", {"cost": q}) for q in (0.5, each(0, 2))] + [("twe", {"nu": nu, "lam": lam}) for nu, lam in ((1e-3, 0.1), (rng.random(pairs), rng.random(pairs)))]
    for ties in (False, True):
        a, b = rng.normal(size=(2, pairs, n)) * scale
        if ties:
            a, b = np.round(a), np.round(b)
        for name, params in sets:
            (low, high), want = R.bounds(name, a, b, params), K.DISTANCES[name](a, b, **params)
            real = np.isfinite(want)
            assert (np.isinf(high) == ~real).all() and (low[real] <= want[real]).all() and (want[real] <= high[real]).all(), name
            assert name != "lcss" or (low == want).all() and (high == want).all()


@pytest.mark.parametrize("splitters, try_all", [("pf2018", False), ("pf2", True), ("pf2h", False)])
def test_trees_are_those_of_exact_distances(monkeypatch, splitters, try_all):
    """the same tree and the same leaves as by exact distances alone, of which few are taken."""
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(400, 32)), rng.integers(0, 4, 400)
    x[200:220] = x[:20]  # copies
    taken, found = [], []
    for exact in (False, True):
        with monkeypatch.context() as m:
            if exact:
                m.setattr(forest, "nearest", forest.distances)
            else:
                for name in ("dtw", "wdtw", "erp", "msm", "twe", "adtw", "lcss"):
                    m.setitem(K.DISTANCES, name, lambda a, b, run=K.DISTANCES[name], **p: taken.append(len(a)) or run(a, b, **p))
            g = forest._Grower(np.arange(400), x, y, 4, np.random.default_rng([1, 2]), OPTIONS | {"splitters": splitters, "try_all": try_all})
            tree = g.grow(np.arange(400))
            out, weight = np.zeros((400, 4)), np.zeros(400)
            forest.walk(tree | ({"hydra": g.hydra} if g.hydra else {}), forest.transforms(x, g.hydra), np.arange(400), out, weight)
            found.append((tree, out.tolist()))
    assert found[0] == found[1]
    assert sum(taken) < 0.1 * 400 * 4 * forest.depth(tree)


def test_trees_hold_each_series_once(spark):
    """F1 to F3: of derivatives and features too; the text of a tree was some 1800 bytes a series."""
    series = D.embedding_series(spark, DATA)
    codes = D.encode_labels(series)
    row = forest.fit(series, codes, n_trees=1, candidates=2, splitters="pf2h", seed=3, adtw_pairs=50, hydra_groups=4).first()
    model = json.loads(row["model"])
    assert len(row["model"]) < 1000 * 500 and {n["transform"] for n in _inner(model)} == {"default", "derivative1", "hydra"}
    data = series.orderBy("series_id").collect()
    x = {r["series_id"]: r["values"] for r in data}
    kept = forest.Exemplars(model)
    for node in _inner(model):
        want = np.array([x[i] for i in node["exemplar_ids"]])
        assert np.array_equal(kept.of(node), forest.derive(want) if node["transform"] == "derivative1" else want)
    got = {r["series_id"]: r["probabilities"] for r in forest.votes(spark.createDataFrame([(0, row["model"])], "tree int, model string"), series).collect()}
    plain = dict(model)
    for node in [plain, *_inner(plain)]:
        if "at" in node:
            node["exemplars"] = kept.of(node).tolist()
            del node["at"]
    out, weight = np.zeros((500, len(_leaf(model))), float), np.zeros(500)
    values = np.array([r["values"] for r in data])
    forest.walk(plain, forest.transforms(values, plain.get("hydra")), np.arange(500), out, weight)
    assert [got[r["series_id"]] for r in data] == out.tolist()


def _inner(tree):
    todo = [tree]
    while todo:
        node = todo.pop()
        if "branches" in node:
            yield node
            todo += node["branches"]


def _leaf(tree):
    return tree["p"] if "p" in tree else _leaf(tree["branches"][0])


def test_trees_are_written_down_before_blocks_meet_them(spark):
    """F1 to F3: a product of blocks and trees reads its sides several times, and does not grow the trees again."""
    series = D.embedding_series(spark, DATA)
    model = forest.fit(series, D.encode_labels(series), n_trees=2, candidates=1, splitters="DA", adtw_pairs=20)
    plan = forest.votes(model, series)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and plan.index("REPARTITION_BY_NUM", plan.index("CartesianProduct")) < plan.index("FlatMapGroupsInPandas")
    assert forest.votes(model, series).count() == 1000


def test_features_are_a_byte_each():
    """they were eight, scaled, for all series of a tree and of a block."""
    x = np.random.default_rng(8).normal(size=(200, 16))
    g = forest._Grower(np.arange(200), x, np.arange(200) % 3, 3, np.random.default_rng([1, 2]), OPTIONS | {"splitters": "pf2h"})
    kept = g.data["hydra"]
    assert kept.counts.nbytes == kept.counts.size and forest.transforms(x, g.hydra)["hydra"].counts.nbytes == kept.counts.size
    assert np.array_equal(kept[np.arange(200)], g.data["hydra"].scaler.transform(kept.counts.astype(float)))
    assert forest.features(np.zeros((1, 300)), 4, 1).dtype == np.uint16
