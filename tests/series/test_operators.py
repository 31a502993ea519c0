"""Files, missing data, sampling, voting, forests and streams on small fixtures."""

import json
import math

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from seriesforge.functions import columns as C
from seriesforge.operators import dataset as D
from seriesforge.operators import forest, neighbours as N
from seriesforge.plans import grids
from seriesforge.sources import files


def table(spark, data):
    return spark.createDataFrame([(i, lab, [float(x) for x in v]) for i, (lab, v) in enumerate(data)], "series_id long, label string, values array<double>")


def test_ts_files(spark, tmp_path):
    p = tmp_path / "a.ts"
    p.write_text("# c\n@problemName X\n@timeStamps false\n@univariate true\n@classLabel true a b\n@data\n1,?,3:a\n4,5,6:b\n")
    df, head = files.read_ts(spark, str(p))
    got = {r["series_id"]: (r["label"], r["values"]) for r in df.collect()}
    assert got[1] == ("b", [4, 5, 6]) and got[0][0] == "a" and math.isnan(got[0][1][1]) and head["labels"] == ["a", "b"]
    files.write_ts(df, str(tmp_path / "out"), "X", "hi")
    back, _ = files.read_ts(spark, str(tmp_path / "out"))
    assert {r["series_id"]: r["label"] for r in back.collect()} == {0: "a", 1: "b"}
    p.write_text("@univariate false\n@classlabel false\n@data\n1,2:3,4\n")
    assert files.read_ts(spark, str(p))[0].first()["values"] == [[1, 2], [3, 4]]
    for bad in ("@univariate true\n1,2\n", "@what 1\n@data\n", "@serieslength 0\n@data\n", "@classlabel true a\n@equallength true\n@data\n1,2:a\n1:a\n", "@classlabel true a\n@data\n1,x:a\n"):
        p.write_text(bad)
        with pytest.raises(ValueError):
            files.read_ts(spark, str(p))


def test_csv_and_flat_files(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("% c\n@ c\na,1,,3\nb,inf,-infinity,2,5\n")
    got = {r["label"]: r["values"] for r in files.read_csv(spark, str(p)).collect()}
    assert math.isnan(got["a"][1]) and got["b"] == [math.inf, -math.inf, 2, 5]
    p.write_text("1\t1\tNaN\t3\tNaN\n2\t4\t5\t6\t7\n")
    assert {r["label"]: r["values"] for r in files.read_delimited(spark, str(p)).collect()} == {"1": [1, 2, 3, 3], "2": [4, 5, 6, 7]}
    (tmp_path / "m_X.csv").write_text("1,2,3,4\n5,6,7,8\n")
    (tmp_path / "m_y.csv").write_text("x\ny\n")
    (tmp_path / "m_metadata.csv").write_text("2,2,2\n")
    (tmp_path / "test_indices_fold_0.txt").write_text("1\n")
    train, test = files.read_flat(spark, str(tmp_path), "m", 0)
    assert train.first()["values"] == [[1, 2], [3, 4]] and test.first()["label"] == "y"


def test_missing_and_constant(spark):
    nan = float("nan")
    df = table(spark, [("a", [nan, 1, nan, 3, nan]), ("b", [nan, nan]), ("c", [2, 2, 2]), ("d", [])])
    got = {r["label"]: r["v"] for r in df.select("label", C.interpolate(F.col("values")).alias("v")).collect()}
    assert got["a"] == [1, 1, 2, 3, 3] and all(math.isnan(x) for x in got["b"]) and got["d"] == []
    c = df.where("label = 'c'")
    assert c.select(C.minmax(F.col("values"))).first()[0] == [0.5] * 3 and c.select(C.zscore(F.col("values"))).first()[0] == [2.0] * 3
    assert c.select(C.derivative(F.slice("values", F.lit(1), F.lit(2)))).first()[0] == [2.0, 2.0]
    assert D.sanity_check(df, c) == ["train: variable length", "train: missing data"]


def test_dataset(spark):
    df = table(spark, [("b", [1, 2]), ("a", [1, 2]), (None, [3, 4]), ("b", [5, 6])])
    assert {r["label"]: r["code"] for r in D.encode_labels(df, ["z", "b"]).collect()} == {"b": 1, "a": 2}
    assert {r["label"]: r["code"] for r in D.first_seen_labels(df.where("label IS NOT NULL"), "series_id").collect()} == {"b": 0, "a": 1}
    assert D.duplicates(df).first()["ids"] == [0, 1]
    assert D.stratified_sample(df.where("label = 'b'"), 2.5).count() == 5 and D.stratified_sample(df.where("label = 'b'"), 0).count() == 1
    assert D.stratified_subset(df, 0.5, 1).count() == 2 and D.bag(df, 3, 1).count() == 3
    assert D.complement(df, D.subset(df, df.where("series_id < 2"))).count() == 2
    assert '"size"' not in D.header_json(df, "x").first()[0] or '"name":"x"' in D.header_json(df, "x").first()[0]
    votes = spark.createDataFrame([(1, "x"), (1, "y"), (1, "y"), (2, "b"), (2, "a")], "series_id long, label string")
    assert {r["series_id"]: r["label"] for r in N.majority_vote(votes).collect()} == {1: "y", 2: "a"}
    p = spark.createDataFrame([([0.5, 0.5, 0.0],)], "p array<double>")
    assert p.select(C.most_probable(F.col("p"))).first()[0] == [0, 1]


def test_grids():
    assert len(grids.MSM_COSTS) == 100 and abs(grids.MSM_COSTS[-1] - 100) < 1e-9 and len(grids.TWE_LAMBDA) == 10 and len(grids.cdtw_grid(50)) == 100 and len(grids.lcss_grid(50, 1.0)) == 100
    assert grids.by_name("d1-CDTW1NN-0.5") == {"transform": "derivative1", "distance": "dtw", "params": {"cfe": 0.5}, "family": "CDTW"}
    with pytest.raises(ValueError):
        grids.by_name("DTW9")
    assert grids.by_name("d3-Minkowski1NN-1.0")["transform"] == "derivative3" and grids.by_name("ADTW+1NN")["family"] == "ADTW+"
    assert len(grids.MSM_COSTS) == 100 and abs(grids.MSM_COSTS[0] - 0.01) < 1e-12 and abs(grids.MSM_COSTS[24] - 0.1) < 1e-12 and abs(grids.MSM_COSTS[1] - 0.01375) < 1e-12 and abs(grids.MSM_COSTS[-1] - 100) < 1e-9


def waves(spark, n, seed):
    r, t = np.random.default_rng(seed), np.linspace(0, 4 * np.pi, 32)
    f = (np.sin, lambda x: np.sign(np.sin(x)), lambda x: np.sin(2 * x))
    return table(spark, [("xyz"[i % 3], f[i % 3](t + r.random()) + 0.1 * r.normal(size=32)) for i in range(n)])


def test_interpolation_of_long_gaps_and_infinities(spark):
    nan, inf = float("nan"), math.inf
    df = table(spark, [("a", [nan] * 3 + [inf, 4] + [nan] * 3 + [8] + [nan]), ("b", [5])])
    got = {r["label"]: r["v"] for r in df.select("label", C.interpolate(F.col("values")).alias("v")).collect()}
    assert got == {"a": [inf, inf, inf, inf, 4, 5, 6, 7, 8, 8], "b": [5]}


def test_try_all_and_smooth_leaves(spark):
    train = waves(spark, 30, 1)
    codes = D.encode_labels(train)
    model = forest.fit(train, codes, n_trees=3, splitters="DA:ADTW:LCSS", seed=5, try_all=True, smooth=True, adtw_pairs=50)
    out = forest.predict(model, train).join(train, "series_id").join(codes, "label").collect()
    assert sum(r["predicted"] == r["code"] for r in out) >= 27 and all(0 < min(r["probabilities"]) for r in out)


@pytest.mark.parametrize("preset", ["pf2", "pf2018", "pf2h"])
def test_forest(spark, preset):
    train, test = waves(spark, 45, 1), waves(spark, 30, 2)
    codes = D.encode_labels(train)
    model = forest.fit(train, codes, n_trees=5, candidates=2, splitters=preset, seed=3, adtw_pairs=50).cache()
    again = forest.fit(train, codes, n_trees=5, candidates=2, splitters=preset, seed=3, adtw_pairs=50)
    assert {r["tree"]: r["model"] for r in model.collect()} == {r["tree"]: r["model"] for r in again.collect()}
    out = forest.predict(model, test).join(test, "series_id").join(codes, "label")
    assert out.where("predicted = code").count() >= 26 and all(abs(sum(r["probabilities"]) - 1) < 1e-9 for r in out.collect())


def test_sample_holds_every_class(spark):
    """ceil(share * n) of each class in each tree, at least one: a rare class is in all of them."""
    train = waves(spark, 40, 1).withColumn("label", F.when(F.col("series_id") == 7, "rare").otherwise(F.col("label")))
    codes = D.encode_labels(train)
    rare = codes.where("label = 'rare'").first()["code"]
    model = forest.fit(train, codes, n_trees=6, candidates=1, splitters="DA", seed=3, sample=0.1, adtw_pairs=20).collect()
    assert all(rare in json.loads(r["model"])["labels"] for r in model) and len(model) == 6


def test_registered_forests_see_the_whole_table(spark, monkeypatch):
    from seriesforge import catalog
    seen = []
    monkeypatch.setattr(forest, "fit", lambda *a, **o: seen.append(o))
    monkeypatch.setattr(forest, "predict", lambda model, series: series.withColumn("predicted", F.lit(0)))
    for name in ("forest_pf2", "forest_pf2018", "forest_pf2h", "forest_try_all", "forest_smooth"):
        catalog.QUERIES[name](spark, DATA)
    assert all(o["sample"] == 1.0 and o["adtw_pairs"] == 4000 for o in seen) and len(seen) == 5


def test_scaler_is_fitted_on_all_series(spark):
    from seriesforge import catalog
    from seriesforge.functions.hydra import Hydra, SparseScaler
    x = np.random.default_rng(2).normal(size=(450, 64)).cumsum(axis=1)
    x[:30] = 0
    model = Hydra(64, groups=8, seed=1)
    want = SparseScaler().fit(model.transform(x))
    got = catalog._fitted(table(spark, [("a", v) for v in x]).repartition(7), model)
    assert np.allclose(got.mean, want.mean) and np.allclose(got.sigma, want.sigma)
    raw = np.sqrt(model.transform(x))
    assert np.allclose(got.sigma, raw.std(axis=0) + (raw == 0).mean(axis=0) ** 4 + 1e-8)


def test_all_groups_of_kernels(spark):
    """64 groups in the queries and in the forest, unless others are asked for."""
    from seriesforge import catalog
    for name in ("hydra", "hydra_scaled"):
        assert len(catalog.QUERIES[name](spark, DATA).first()["features"]) == 3 * 64 * 8 * 2
    train = waves(spark, 20, 1)
    codes = D.encode_labels(train)
    for options, groups in (({}, 64), ({"hydra_groups": 4}, 4)):
        model = json.loads(forest.fit(train, codes, n_trees=1, candidates=1, splitters="HYDRA:HYDRA", seed=3, adtw_pairs=20, **options).first()["model"])
        length = len(train.first()["values"])
        assert model["hydra"]["groups"] == groups and len(model["hydra"]["mean"]) % (groups * 16) == 0 and len(model["exemplars"][0]) == length


def test_resample_reaches_the_test_half(spark):
    """On 2000 series too, where the first 400 positions are all in train."""
    from seriesforge import catalog
    ids = {r["series_id"] for r in catalog.QUERIES["resample_whole"](spark, "/root/testdata/sf0.1").collect()}
    assert ids == set(range(0, 2000, 3)) and max(ids) >= 1000


def test_numbers_of_a_table_too_large_to_sample_whole(spark):
    """Each row has its own place in id order, whatever the partitions, with and without the other columns."""
    n = 60_000
    ids = spark.range(0, 7 * n, 7, 3).select(F.col("id").alias("series_id"), F.col("id").cast("string").alias("label"), F.array(F.col("id").cast("double")).alias("values"))
    got = D.numbered(ids.repartition(5, F.xxhash64("series_id"))).select("series_id", "label").collect()
    assert sorted(r["series_id"] for r in got) == list(range(n)) and all(int(r["label"]) == 7 * r["series_id"] for r in got)
    assert D.numbered(ids.limit(0)).count() == 0 and [r["series_id"] for r in D.numbered(ids.limit(1)).collect()] == [0]


@pytest.mark.parametrize("name", ["resample", "resample_whole"])
def test_resample_of_a_large_table_against_sql(spark, oracle, tmp_path, name):
    """So many series a partition that range partitions are sampled, and the first 400 positions are in two of them."""
    from conftest import rows
    from seriesforge import catalog
    made = spark.range(0, 60_000, 1, 3).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("float")).alias("embedding"), F.pmod(F.xxhash64("id"), F.lit(1000)).cast("int").alias("label"))
    made.write.parquet(str(tmp_path / "embeddings.parquet"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "80")
    try:
        assert rows(catalog.QUERIES[name](spark, str(tmp_path))) == oracle(catalog.ORACLES[name], str(tmp_path))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_stream(spark, tmp_path):
    from seriesforge.streaming.scoring import score_stream

    train, test = waves(spark, 45, 1), waves(spark, 12, 2)
    test.write.parquet(str(tmp_path / "in"))
    q = score_stream(spark.readStream.schema(test.schema).parquet(str(tmp_path / "in")), train, str(tmp_path / "out"), str(tmp_path / "cp"), "dtw", window=4)
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).where("correct").count() >= 11


def test_command_line(spark, tmp_path):
    import json

    from seriesforge import __main__ as cli

    for part, n, seed in (("TRAIN", 30, 1), ("TEST", 15, 2)):
        files.write_ts(waves(spark, n, seed), str(tmp_path / "waves" / f"waves_{part}.ts"), "waves")
    a = cli.arguments(["--ucr", str(tmp_path), "waves", "--pfc", "pf2", "-t", "5", "-c", "2", "-o", str(tmp_path / "r.json"), "--probout", str(tmp_path / "p")])
    out = cli.run(spark, a)
    assert out["accuracy"] >= 0.8 and json.loads((tmp_path / "r.json").read_text()) == out and out["classifier"]["trees"] == 5
    assert spark.read.csv(str(tmp_path / "p"), header=True).columns == ["series_id", "x", "y", "z"]
    with pytest.raises(SystemExit):
        cli.arguments(["-t", "5"])


def test_numbers_follow_file_order(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text("".join(f"a,{i * 100 + k}\n" for k in range(5)))
    got = files.read_csv(spark, str(tmp_path)).collect()
    assert sorted(r["series_id"] for r in got) == list(range(15))
    for i in range(3):
        ids = [r["series_id"] for r in sorted(got, key=lambda r: r["values"][0]) if r["values"][0] // 100 == i]
        assert ids == list(range(ids[0], ids[0] + 5))


@pytest.mark.parametrize("splitter", ["DA", "DTW", "DTWFull", "WDTW", "LCSS", "ERP", "MSM", "TWE", "ADTW"])
def test_a_small_node_takes_one_kernel_call(monkeypatch, splitter):
    """The same distances as one call for each exemplar, also where a node needs several calls."""
    from seriesforge.functions import kernels as K
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(40, 12)), np.arange(40) % 5
    options = {"splitters": splitter + ":d1" if splitter == "WDTW" else splitter, "adtw_pairs": 20, "hydra_groups": 4}
    grower, calls = forest._Grower(np.arange(40), x, y, 5, rng, options), []
    kernel, transform, params = grower.draw(np.arange(40), splitter)
    v, run = grower.data[transform], K.DISTANCES[kernel]
    monkeypatch.setattr(grower, "draw", lambda rows, spec=None: (kernel, transform, params))
    monkeypatch.setitem(K.DISTANCES, kernel, lambda a, b, **p: calls.append(len(a)) or run(a, b, **p))
    grower.split(np.arange(40))
    assert calls == [200]
    want = np.stack([run(v, np.broadcast_to(v[p], v.shape), **params) for p in (3, 8, 31)], axis=1)
    for pairs in (7, 4096):
        monkeypatch.setattr(forest, "PAIRS", pairs)
        assert (forest.to_exemplars(kernel, v, v[[3, 8, 31]], params) == want).all()


def test_every_tree_has_a_task_of_its_own(spark):
    for n in (1, 8, 13):
        seats = forest._seats(spark.range(1), n)
        assert sorted(r["tree"] for r in seats.collect()) == list(range(n))
        assert {r["count"] for r in seats.repartition(n, "seat").groupBy(F.spark_partition_id().alias("p")).count().collect()} == {1}


def _counted(monkeypatch):
    from seriesforge.functions import kernels as K
    calls = []
    for name in ("directa", "dtw", "wdtw", "lcss", "erp", "msm", "twe", "adtw"):
        monkeypatch.setitem(K.DISTANCES, name, lambda a, b, run=K.DISTANCES[name], **p: calls.append(len(a)) or run(a, b, **p))
    return calls


@pytest.mark.parametrize("splitters, try_all", [("pf2", True), ("pf2h", False), ("pf2018", False)])
def test_nodes_of_a_level_share_kernel_calls(monkeypatch, splitters, try_all):
    """A tree of many small nodes takes far fewer elastic calls than it has splits, grown or walked, and is the same again."""
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(600, 12)), rng.integers(0, 3, 600)
    options = {"splitters": splitters, "adtw_pairs": 20, "hydra_groups": 2, "candidates": 2, "max_depth": 64, "min_size": 1, "smooth": False, "try_all": try_all, "min_gini": 0.0, "stop_on_empty": False}
    trees = []
    for _ in range(2):
        grower = forest._Grower(np.arange(600), x, y, 3, np.random.default_rng([1, 2]), options)
        calls = _counted(monkeypatch)
        trees.append(grower.grow(np.arange(600)))
        monkeypatch.undo()
    tree = trees[0]
    assert trees[1] == tree
    inner, todo, leaves = [], [tree], []
    while todo:
        node = todo.pop()
        (inner if "branches" in node else leaves).append(node)
        todo += node.get("branches", ())
    elastic = sum(n["kernel"] != "directa" for n in inner)
    assert len(inner) > 100 and sum(n["size"] for n in leaves) == 600
    assert len(calls) < len(inner) * (3 if try_all else 2) * 0.8
    tree = tree | ({"hydra": grower.hydra} if grower.hydra else {})
    out, weight = np.zeros((600, 3)), np.zeros(600)
    calls = _counted(monkeypatch)
    forest.walk(tree, forest.transforms(x, grower.hydra), np.arange(600), out, weight)
    assert len(calls) < 0.8 * len(inner) and elastic and (weight == 1).all() and np.allclose(out.sum(axis=1), 1)


def test_shared_calls_give_each_task_its_own_distances(monkeypatch):
    """Penalties, thresholds, gaps and weights differ from pair to pair; parts of a task may be in different calls."""
    from seriesforge.functions import kernels as K
    rng = np.random.default_rng(7)
    x, e = rng.normal(size=(50, 12)), rng.normal(size=(9, 12))
    params = [("adtw", {"cfe": c, "penalty": p}) for c in (1.0, 2.0) for p in (0.0, 0.3, 2.0)] + [("lcss", {"epsilon": p, "window": w}) for p in (0.1, 0.7) for w in (1, 3)]
    params += [("erp", {"cfe": 2.0, "gap": g, "window": 3}) for g in (0.1, 0.9)] + [("msm", {"cost": c}) for c in (0.1, 1.0)] + [("wdtw", {"cfe": 2.0, "g": g}) for g in (0.1, 0.9)]
    params += [("twe", {"nu": n, "lam": l}) for n in (1e-4, 0.1) for l in (0.0, 0.5)] + [("dtw", {"cfe": 0.5, "window": w}) for w in (0, 2)] + [("directa", {"cfe": 1.0})] * 2
    tasks = [forest.Task(k, "default", p, x, rng.choice(50, 7 + i), e, rng.choice(9, 1 + i % 4)) for i, (k, p) in enumerate(params)]
    for pairs in (5, 64, 4096):
        monkeypatch.setattr(forest, "PAIRS", pairs)
        for t, d in zip(tasks, forest.distances(tasks)):
            want = np.stack([K.DISTANCES[t.kernel](t.x[t.rows], np.broadcast_to(t.exemplars[p], (len(t.rows), 12)), **t.params) for p in t.picks], axis=1)
            assert np.array_equal(d, want), t.kernel


def test_only_visited_nodes_make_features(spark, monkeypatch):
    """One series visits a path of the tree; the exemplars of the other nodes stay series."""
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(200, 16)), rng.integers(0, 3, 200)
    options = {"splitters": "HYDRA:HYDRA", "adtw_pairs": 20, "hydra_groups": 4, "candidates": 1, "max_depth": 64, "min_size": 1, "smooth": False, "try_all": False, "min_gini": 0.0, "stop_on_empty": False}
    made, run = [], forest.features
    monkeypatch.setattr(forest, "features", lambda v, *a: made.append(len(v)) or run(v, *a))
    grower = forest._Grower(np.arange(200), x, y, 3, rng, options)
    tree = grower.grow(np.arange(200))
    assert sum(made) == 200  # once, for the scaling and the splits
    tree["hydra"] = grower.hydra
    made.clear()
    t = table(spark, [("a", v) for v in x[:1]])
    model = spark.createDataFrame([(0, json.dumps(tree))], "tree int, model string")
    assert forest.votes(model, t).count() == 1
    out, weight = np.zeros((1, 3)), np.zeros(1)
    forest.walk(tree, forest.transforms(x[:1], grower.hydra), np.arange(1), out, weight)
    assert weight[0] == 1 and sum(made) <= 1 + 3 * forest.depth(tree) < 1 + 2 * (forest.count_nodes(tree) // 3)


def test_counts_take_the_first_of_equal_answers():
    """As argmax and argmin do, also where windows are all zero, constant or not a number."""
    from seriesforge.functions.hydra import Hydra
    x = np.random.default_rng(9).normal(size=(5, 20))
    x[1], x[2, :10], x[3, 4] = 0, 0, np.nan
    h = Hydra(20, groups=4, seed=1)
    want = []
    for di, d in enumerate(h.dilations):
        for which, series in enumerate((x, np.diff(x, axis=1))):
            windows = np.lib.stride_tricks.sliding_window_view(np.pad(series, ((0, 0), (4 * d, 4 * d))), 8 * d + 1, axis=1)[:, :, ::d]
            answers = np.einsum("stk,gpk->sgpt", windows, h.kernels[di, which])
            want.append(np.stack([np.eye(8)[pick(answers, axis=2)].sum(axis=2) for pick in (np.argmax, np.argmin)], axis=-1))
    assert (h.transform(x, by_group=True) == np.concatenate(want, axis=1)).all()
