"""Proximity forest: trees whose nodes send a series to the branch of its nearest exemplar under a random elastic distance.

Trees are independent: every tree's (sampled) training rows are shuffled to one task, which grows it in numpy and emits
it as one row of JSON.  Prediction pairs blocks of series with trees and averages the leaf probabilities by weight.
Each tree has a generator of its own from (seed, tree), from which each node's is spawned, so results do not depend on scheduling.
Trees grow and are walked level by level: the many small nodes of a level share kernel calls.  Distances in 32 bits decide which
branch is nearest; where their error leaves several, exact ones do.
"""

from __future__ import annotations

import base64
import json
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import rough as R
from ..functions.hydra import Hydra, SparseScaler, merged, moments
from ..plans import grids
from .dataset import pseudo_random
from .neighbours import weighted_average

PRESETS = {
    "pf2": ["ADTW", "DTW", "LCSS"],
    "pf2018": ["DA", "DTW", "DTW:d1", "DTWFull", "DTWFull:d1", "WDTW", "WDTW:d1", "LCSS", "ERP", "MSM", "TWE"],
    "pf2h": ["ADTW", "DTW", "LCSS", "HYDRA"],
}
TRANSFORMS = ("default", "derivative1")
#: Series whose random-convolution features are made at once: their windows are many times as large.
CHUNK = 16
#: Series whose features are summed up at once for the scaling.
MOMENTS = 1024
#: Pairs of a kernel call, fewer where series are longer than POINTS / PAIRS.
PAIRS, POINTS = 1024, 1 << 18
#: Parameters that the pairs of a kernel call may have different values of.
SPREAD = {"adtw": {"penalty"}, "lcss": {"epsilon"}, "erp": {"gap"}, "msm": {"cost"}, "wdtw": {"g"}, "twe": {"nu", "lam"}}
#: Series of a block of prediction on average: its tree is read for each.  Tables of more than PARTS such blocks have larger ones, up to MOST.
BLOCK, PARTS, MOST = 4096, 4, 32768
#: Series whose scaled features are compared at once.
ROWS = 64


def derive(x: np.ndarray) -> np.ndarray:
    if x.shape[1] <= 2:
        return x
    mid = ((x[:, 1:-1] - x[:, :-2]) + (x[:, 2:] - x[:, :-2]) / 2) / 2
    return np.concatenate([mid[:, :1], mid, mid[:, -1:]], axis=1)


class Counts:
    """Random-convolution features as they are counted, in a byte or two each; they are scaled where they are needed."""

    def __init__(self, counts: np.ndarray, scaler: SparseScaler):
        self.counts, self.scaler, self.shape = counts, scaler, counts.shape

    def __len__(self) -> int:
        return len(self.counts)

    def __getitem__(self, rows: np.ndarray) -> np.ndarray:
        return self.scaler.transform(self.counts[rows].astype(float))


def features(x: np.ndarray, groups: int, seed: int) -> np.ndarray:
    model, out = Hydra(x.shape[1], groups, seed), None
    for at in range(0, len(x), CHUNK):
        made = model.transform(x[at:at + CHUNK])
        if out is None:
            out = np.empty((len(x), made.shape[1]), np.min_scalar_type(x.shape[1]))  # no more than there are points
        out[at:at + CHUNK] = made
    return out


def scaled(x: np.ndarray, hydra: dict) -> Counts:
    scaler = SparseScaler()
    scaler.mean, scaler.sigma = np.array(hydra["mean"]), np.array(hydra["sigma"])
    return Counts(features(x, hydra["groups"], hydra["seed"]), scaler)


def transforms(x: np.ndarray, hydra: dict | None) -> dict[str, np.ndarray | Counts]:
    """The series under every transform; hydra holds the seed and the fitted scaling of random-convolution features."""
    out = {"default": x, "derivative1": derive(x)}
    if hydra:
        out["hydra"] = scaled(x, hydra)
    return out


def gini(y: np.ndarray) -> float:
    if len(y) <= 1:
        return 0.0
    p = np.unique(y, return_counts=True)[1] / len(y)
    return float(1 - (p * p).sum())


class Task(NamedTuple):
    """Distances of x[rows] to exemplars[picks]."""
    kernel: str
    transform: str
    params: dict
    x: np.ndarray | Counts
    rows: np.ndarray
    exemplars: np.ndarray | Counts
    picks: np.ndarray


def distances(tasks: list[Task], measure: Callable | None = None, most: int | None = None) -> list[np.ndarray]:
    """Distances (rows, picks) of each task.  A kernel call takes so many pairs that the small tasks of one kernel share it and large ones
    stay in the cache.

    measure(kernel, a, b, parameters): what else to take, (2, pairs), which gives (2, rows, picks); most: pairs of its calls.
    """
    kinds = () if measure is None else (2,)
    measure = measure or (lambda kernel, a, b, params: K.DISTANCES[kernel](a, b, **params))
    out, groups = [np.empty((*kinds, len(t.rows) * len(t.picks))) for t in tasks], defaultdict(list)
    for i, t in enumerate(tasks):
        fixed = tuple(sorted((k, v) for k, v in t.params.items() if k not in SPREAD.get(t.kernel, ())))
        groups[t.kernel, t.x.shape[1], fixed].append(i)

    def run(call: list[tuple[int, int, int]]) -> None:
        places = [np.divmod(np.arange(lo, hi), len(tasks[i].picks)) for i, lo, hi in call]
        a = np.concatenate([tasks[i].x[tasks[i].rows[row]] for (i, _, _), (row, _) in zip(call, places)])
        b = np.concatenate([tasks[i].exemplars[tasks[i].picks[col]] for (i, _, _), (_, col) in zip(call, places)])
        first = tasks[call[0][0]]
        params = first.params
        if len(call) > 1:
            sizes = [hi - lo for _, lo, hi in call]
            params = params | {k: np.repeat([tasks[i].params[k] for i, _, _ in call], sizes) for k in SPREAD.get(first.kernel, ()) if k in params}
        d, at = measure(first.kernel, a, b, params), 0
        for i, lo, hi in call:
            out[i][..., lo:hi] = d[..., at:at + hi - lo]
            at += hi - lo

    for (_, length, _), members in groups.items():
        step, call, held = max(1, min(most or PAIRS, POINTS // max(1, length))), [], 0
        for i in members:
            lo, size = 0, out[i].shape[-1]
            while lo < size:
                hi = min(size, lo + step - held)
                call.append((i, lo, hi))
                held, lo = held + hi - lo, hi
                if held == step:
                    run(call)
                    call, held = [], 0
        if call:
            run(call)
    return [d.reshape(*kinds, len(t.rows), len(t.picks)) for t, d in zip(tasks, out)]


def nearest(tasks: list[Task]) -> list[np.ndarray]:
    """Numbers (rows, picks) of each task that are least where its distances are; the others may be infinite."""
    out: list = [None] * len(tasks)
    kinds = ["features" if isinstance(t.x, Counts) else "plain" if t.kernel == "directa" else "elastic" for t in tasks]
    by = {kind: [i for i, k in enumerate(kinds) if k == kind] for kind in ("features", "plain", "elastic")}
    for i, d in zip(by["plain"], distances([tasks[i] for i in by["plain"]])):
        out[i] = d
    found = [(i, among_features(tasks[i])) for i in by["features"]] + list(zip(by["elastic"], distances([tasks[i] for i in by["elastic"]], R.bounds, R.PAIRS)))
    again = []
    for i, (low, high) in found:
        if np.array_equal(low, high, equal_nan=True):
            out[i] = low
            continue
        may = low <= high.min(axis=1, keepdims=True)
        out[i] = np.where(may, low, np.inf)
        several = may.sum(axis=1)
        rows = np.nonzero((several == 0) | (several > 1) & (may & (low != high)).any(axis=1))[0]
        if len(rows):
            again.append((i, rows))
    for (i, rows), d in zip(again, distances([tasks[i]._replace(rows=tasks[i].rows[rows]) for i, rows in again])):
        out[i][rows] = d
    return out


def among_features(task: Task) -> np.ndarray:
    """(2, rows, picks): the least and the most that direct distances of features can be."""
    cfe, e = task.params["cfe"], task.exemplars[task.picks]
    low, high = out = np.empty((2, len(task.rows), len(task.picks)))
    for at in range(0, len(task.rows), ROWS):
        part = slice(at, at + ROWS)
        x = task.x[task.rows[part]]
        if cfe == 2.0:
            size = (x * x).sum(axis=1)[:, None] + (e * e).sum(axis=1)[None, :]
            d = size - 2 * (x @ e.T)
            low[part], high[part] = d - 1e-9 * size, d + 1e-9 * size
        elif cfe == 1.0:
            off = x.shape[1] * R.ERROR * max(np.abs(x).max(initial=0.0), np.abs(e).max(initial=0.0))
            x = x.astype(np.float32)
            c = np.empty_like(x)
            for k, y in enumerate(e.astype(np.float32)):
                d = np.abs(np.subtract(x, y, out=c), out=c).sum(axis=1).astype(float)
                low[part, k], high[part, k] = d * (1 - 200 * R.ROUND) - off, d * (1 + 200 * R.ROUND) + off  # sums of parts of 128, by pairs
        else:
            for k in range(len(e)):
                low[part, k] = high[part, k] = K.directa(x, e[k:k + 1], cfe)
    return out


def to_exemplars(kernel: str, x: np.ndarray, exemplars: np.ndarray, params: dict) -> np.ndarray:
    """Distances (series, exemplars)."""
    return distances([Task(kernel, "default", params, x, np.arange(len(x)), exemplars, np.arange(len(exemplars)))])[0]


class _Grower:
    def __init__(self, ids, x, y, n_classes, rng, options):
        self.ids, self.y, self.k, self.rng, self.o = ids, y, n_classes, rng, options
        self.names = PRESETS.get(options["splitters"]) or options["splitters"].split(":")
        self.penalties, self.hydra = {}, None
        if "HYDRA" in self.names:
            seed = int(rng.integers(1 << 31))
            found = features(x, self.o["hydra_groups"], seed)
            scaler = SparseScaler().fit_moments(reduce(merged, (moments(found[at:at + MOMENTS].astype(float)) for at in range(0, len(found), MOMENTS))))
            self.hydra = {"seed": seed, "groups": self.o["hydra_groups"], "mean": scaler.mean.tolist(), "sigma": scaler.sigma.tolist()}
        self.data = transforms(x, None) | ({"hydra": Counts(found, scaler)} if self.hydra else {})
        for t in TRANSFORMS:
            v = self.data[t]
            for e in (0.5, 1.0, 2.0):
                i, j = rng.integers(0, len(v), (2, self.o["adtw_pairs"]))
                m = float(K.directa(v[i], v[j], e).mean())
                self.penalties[t, e] = [0.0] + [m * (s / 100) ** 5 for s in range(1, 100)]

    def draw(self, rows: np.ndarray, spec: str | None = None) -> tuple[str, str, dict]:
        """A random distance, of the splitter named by spec or of any: (kernel, transform, parameters)."""
        name, _, fixed = (spec or self.names[self.rng.integers(len(self.names))]).partition(":")
        free = self.o["splitters"] != "pf2018"
        t = "derivative1" if fixed == "d1" else TRANSFORMS[self.rng.integers(2)] if free else "default"
        e = float(self.rng.choice([0.5, 1.0, 2.0])) if free else 2.0
        length = self.data[t].shape[1]
        sigma = (float(self.data[t][rows].std(ddof=1)) if self.data[t][rows].size > 1 else 1.0) if name in ("LCSS", "ERP") else None
        w = grids.random_window(self.rng, length)
        if name == "HYDRA":
            return "directa", "hydra", {"cfe": e}
        if name == "DA":
            return "directa", t, {"cfe": e}
        if name == "DTW":
            return "dtw", t, {"cfe": e, "window": w}
        if name == "DTWFull":
            return "dtw", t, {"cfe": e}
        if name == "WDTW":
            return "wdtw", t, {"cfe": e, "g": float(self.rng.random())}
        if name == "LCSS":
            return "lcss", t, {"epsilon": grids.random_epsilon(self.rng, sigma), "window": w}
        if name == "ERP":
            return "erp", t, {"cfe": e, "gap": grids.random_epsilon(self.rng, sigma), "window": w}
        if name == "MSM":
            return "msm", t, {"cost": float(self.rng.choice(grids.MSM_COSTS))}
        if name == "TWE":
            return "twe", t, {"nu": float(self.rng.choice(grids.TWE_NU)), "lam": float(self.rng.choice(grids.TWE_LAMBDA))}
        if name == "ADTW":
            return "adtw", t, {"cfe": e, "penalty": float(self.rng.choice(self.penalties[t, e]))}
        raise ValueError(f"unknown splitter {name!r}")

    def propose(self, rows: np.ndarray, spec: str | None = None) -> Task:
        kernel, t, params = self.draw(rows, spec)
        picks = np.array([self.rng.choice(rows[self.y[rows] == c]) for c in np.unique(self.y[rows])])
        return Task(kernel, t, params, self.data[t], rows, self.data[t], picks)

    def judge(self, task: Task, d: np.ndarray) -> tuple[float, np.ndarray]:
        """(impurity of the branches, each row's branch)."""
        at, n = np.searchsorted(self.y[task.picks], self.y[task.rows]), len(task.picks)  # picks are in the order of their classes
        near = d == d.min(axis=1, keepdims=True)
        own = near[np.arange(len(at)), at]
        branch = np.where(own, at, (near * self.rng.random(near.shape)).argmax(axis=1))
        counts = np.bincount(branch * n + at, minlength=n * n).reshape(n, n)
        sizes = counts.sum(axis=1)
        p = counts / np.maximum(sizes, 1)[:, None]
        return float((sizes * (1 - (p * p).sum(axis=1))).sum() / len(at)), branch

    def node(self, task: Task) -> dict:
        kept = self.data["default" if task.transform == "hydra" else task.transform]
        held = {"at": task.picks.tolist()} if self.o.get("apart") else {"exemplars": [kept[p].tolist() for p in task.picks]}
        return {"kernel": task.kernel, "transform": task.transform, "params": task.params} | held | {
                "exemplar_ids": [int(self.ids[p]) for p in task.picks], "labels": [int(self.y[p]) for p in task.picks]}

    def split(self, rows: np.ndarray, spec: str | None = None) -> tuple[float, dict, np.ndarray]:
        task = self.propose(rows, spec)
        impurity, branch = self.judge(task, distances([task])[0])
        return impurity, self.node(task), branch

    def leaf(self, rows: np.ndarray, label: int | None = None) -> dict:
        n = np.bincount(self.y[rows], minlength=self.k).astype(float)
        if not len(rows):
            n[label] = 1
        if self.o["smooth"]:
            p, weight = (1 + n) / (self.k + n.sum()), self.k + n.sum()
        else:
            p, weight = n / n.sum(), 1.0
        return {"p": p.tolist(), "weight": float(weight), "size": len(rows)}

    def grow(self, rows: np.ndarray) -> dict:
        root: dict = {}
        level = [(root, rows, None, None)]
        for depth in range(self.o["max_depth"] + 1):
            tried = []
            for node, rows, label, seed in level:
                if len(np.unique(self.y[rows])) <= 1 or depth >= self.o["max_depth"] or len(rows) <= self.o["min_size"] or gini(self.y[rows]) <= self.o["min_gini"]:
                    node |= self.leaf(rows, label)
                else:
                    if seed is not None:  # generators are far larger than their seeds, and leaves need none
                        self.rng = np.random.Generator(type(self.rng.bit_generator)(seed))
                    specs = self.names if self.o["try_all"] else [None] * self.o["candidates"]
                    tried.append((node, rows, label, self.rng, [self.propose(rows, spec) for spec in specs]))
            made, level = iter(nearest([t for *_, tasks in tried for t in tasks])), []
            for node, rows, label, self.rng, tasks in tried:
                tries = [(*self.judge(t, next(made)), t) for t in tasks]
                best = [t for t in tries if t[0] == min(t[0] for t in tries)]
                _, branch, task = best[self.rng.integers(len(best)) if self.o["try_all"] else 0]  # else the first of the least
                if self.o["stop_on_empty"] and len(np.unique(branch)) < len(task.picks):
                    node |= self.leaf(rows, label)
                    continue
                node |= self.node(task) | {"branches": [{} for _ in task.picks]}
                level += [(child, rows[branch == b], c, seed) for b, (child, c, seed) in enumerate(zip(node["branches"], node["labels"], self.rng.bit_generator.seed_seq.spawn(len(task.picks))))]
        return root


def count_nodes(tree: dict) -> int:
    return 1 + sum(map(count_nodes, tree.get("branches", ())))


def depth(tree: dict) -> int:
    return 1 + max(map(depth, tree["branches"])) if "branches" in tree else 0


def apart(tree: dict, x: np.ndarray) -> dict:
    """The tree with one copy of every series that is an exemplar of a node; its root has its own as numbers too."""
    used, todo = [], [tree]
    while todo:
        node = todo.pop()
        used += node.get("at", ())
        todo += node.get("branches", ())
    if not used:
        return tree
    rows = np.unique(used)
    values = x[rows]
    kind = "<f4" if np.array_equal(values.astype("<f4").astype(float), values) else "<f8"
    coded = lambda v, k: base64.b64encode(np.ascontiguousarray(v, k).tobytes()).decode()
    own = (derive(x[tree["at"]]) if tree["transform"] == "derivative1" else x[tree["at"]]).tolist()
    return tree | {"exemplars": own, "series": {"rows": coded(rows, "<i8"), "values": coded(values, kind), "kind": kind}}


class Exemplars:
    """Series of the exemplars of a tree's nodes."""

    def __init__(self, tree: dict):
        if kept := tree.get("series"):
            plain = lambda v, k: np.frombuffer(base64.b64decode(v), k)
            self.rows = plain(kept["rows"], "<i8")
            self.values = plain(kept["values"], kept["kind"]).reshape(len(self.rows), -1).astype(float)

    def of(self, node: dict) -> np.ndarray:
        if "at" not in node:
            return np.array(node["exemplars"], float)
        found = self.values[np.searchsorted(self.rows, node["at"])]
        return derive(found) if node["transform"] == "derivative1" else found


def featured(nodes: list[dict], hydra: dict, kept: Exemplars) -> dict[int, Counts]:
    """Exemplars of random-convolution nodes, by place: they are kept as series, which are far shorter; here they become features, all at once."""
    at = [i for i, node in enumerate(nodes) if node["transform"] == "hydra"]
    if not at:
        return {}
    series = [kept.of(nodes[i]) for i in at]
    made = scaled(np.concatenate(series), hydra)
    return {i: Counts(part, made.scaler) for i, part in zip(at, np.split(made.counts, np.cumsum([len(e) for e in series])[:-1]))}


def walk(tree: dict, x: dict[str, np.ndarray | Counts], rows: np.ndarray, out: np.ndarray, weight: np.ndarray, kept: Exemplars | None = None) -> None:
    level, kept = [(tree, rows)], kept or Exemplars(tree)
    while level:
        inner = []
        for node, rows in level:
            if "branches" in node:
                inner.append((node, rows))
            else:
                out[rows], weight[rows] = node["p"], node["weight"]
        made = featured([node for node, _ in inner], tree.get("hydra"), kept)
        exemplars = [made[i] if i in made else kept.of(node) for i, (node, _) in enumerate(inner)]
        found = nearest([Task(node["kernel"], node["transform"], node["params"], x[node["transform"]], rows, e, np.arange(len(e))) for (node, rows), e in zip(inner, exemplars)])
        level = []
        for (node, rows), d in zip(inner, found):
            to = d.argmin(axis=1)
            level += [(child, rows[to == b]) for b, child in enumerate(node["branches"]) if (to == b).any()]


def _seats(train: DataFrame, n: int) -> DataFrame:
    """(tree, seat): keys that a shuffle to n partitions deals out one a partition; hashes of the trees' numbers would share some."""
    keys = train.sparkSession.range(64 * n).select(F.col("id").alias("seat"))
    return keys.groupBy(F.pmod(F.hash("seat"), F.lit(n)).alias("tree")).agg(F.min("seat").alias("seat"))


def fit(train: DataFrame, codes: DataFrame, n_trees: int = 10, candidates: int = 5, splitters: str = "pf2", seed: int = 0, max_depth: int = 64, min_size: int = 1,
        smooth: bool = False, sample: float = 1.0, adtw_pairs: int = 4000, try_all: bool = False, hydra_groups: int = 64,
        min_gini: float = 0.0, stop_on_empty: bool = False) -> DataFrame:
    """(tree, model json, nodes, depth).  codes(label, code) from encode_labels; sample: share of each class that a tree sees, rounded up;
    try_all: a node tries every splitter once and picks at random among the best, else `candidates` random ones; min_gini: nodes
    up to this impurity are leaves; stop_on_empty: so is a node with a branch that no series takes."""
    options = {"candidates": candidates, "splitters": splitters, "max_depth": max_depth, "min_size": min_size, "smooth": smooth, "adtw_pairs": adtw_pairs, "try_all": try_all, "hydra_groups": hydra_groups,
               "min_gini": min_gini, "stop_on_empty": stop_on_empty, "apart": True}
    k = codes.count()

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("series_id")
        tree = int(pdf["tree"].iloc[0])
        g = _Grower(pdf["series_id"].to_numpy(), np.array(pdf["values"].tolist(), float), pdf["code"].to_numpy(int), k, np.random.default_rng([seed, tree]), options)
        model = g.grow(np.arange(len(pdf)))
        root = apart(model, g.data["default"]) | ({"hydra": g.hydra} if g.hydra else {})
        return pd.DataFrame({"seat": [int(pdf["seat"].iloc[0])], "tree": [tree], "model": [json.dumps(root)], "nodes": [count_nodes(model)], "depth": [depth(model)]})

    labelled = train.join(codes, "label").select("series_id", "code", "values")
    dealt = labelled.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree"))
    if sample < 1:
        of_class = Window.partitionBy("tree", "code")
        drawn = of_class.orderBy(pseudo_random(F.concat_ws(":", "tree", "series_id"), seed), "series_id")
        ranked = dealt.select("*", F.row_number().over(drawn).alias("rank"), F.count(F.lit(1)).over(of_class).alias("n"))
        dealt = ranked.where(F.col("rank") <= F.greatest(F.ceil(F.lit(sample) * F.col("n")), F.lit(1))).drop("rank", "n")
    seated = dealt.join(F.broadcast(_seats(train, n_trees)), "tree", "left")  # a row a tree
    dealt = seated.withColumn("seat", F.coalesce("seat", -F.col("tree").cast("long") - 1)).repartition(n_trees, "seat")
    grown = dealt.groupBy("seat", "tree").applyInPandas(grow, "seat long, tree int, model string, nodes long, depth int")
    return grown.repartition(n_trees, "seat").drop("seat")  # trees are written down: who reads them several times does not grow them again


def votes(model: DataFrame, test: DataFrame) -> DataFrame:
    """(series_id, tree, probabilities, weight)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            qs, trees, texts = (list(batch.pop(c)) for c in ("q", "tree", "model"))
            while texts:  # what is done with is let go: trees are large
                q, tree, m = qs.pop(), trees.pop(), json.loads(texts.pop())
                x, ids = np.array([s["values"] for s in q], float), [s["series_id"] for s in q]
                del q
                kept = Exemplars(m)
                m.pop("series", None)
                out, weight = np.zeros((len(x), _classes(m))), np.zeros(len(x))
                walk(m, transforms(x, m.get("hydra")), np.arange(len(x)), out, weight, kept)
                yield pd.DataFrame({"series_id": ids, "tree": tree, "probabilities": list(out), "weight": weight})

    n = test.count()
    n = max(-(-n // MOST), min(PARTS, -(-n // BLOCK)), 1)
    named = test.select(F.pmod(F.xxhash64("series_id"), F.lit(n)).cast("int").alias("part"), F.struct("series_id", "values").alias("s"))
    seats = _seats(test, n).select(F.col("tree").cast("int").alias("part"), "seat")
    blocks = named.join(F.broadcast(seats), "part", "left").repartition(n, "seat").groupBy("seat").agg(F.collect_list("s").alias("q"))  # a row a seat
    pairs = blocks.hint("shuffle_replicate_nl").crossJoin(model.select("tree", "model"))  # a task for each block and tree, where neither moves again
    return pairs.select("q", "tree", "model").mapInPandas(run, "series_id long, tree int, probabilities array<double>, weight double")


def _classes(tree: dict) -> int:
    return len(tree["p"]) if "p" in tree else _classes(tree["branches"][0])


def predict(model: DataFrame, test: DataFrame, vote: str = "average") -> DataFrame:
    """(series_id, probabilities, predicted code); the least code on ties.

    vote: `average` of the leaves' probabilities by weight, or `majority`, where each tree has one vote for its most probable
    class (the least code on ties) and probabilities are shares of votes.
    """
    found = votes(model, test)
    if vote == "majority":
        top = F.array_position("probabilities", F.array_max("probabilities")) - 1
        one = F.transform("probabilities", lambda _p, i: (i == top).cast("double"))
        found = found.select("series_id", "tree", one.alias("probabilities"), F.lit(1.0).alias("weight"))
    elif vote != "average":
        raise ValueError(f"unknown vote {vote!r}")
    return weighted_average(found).withColumn("predicted", (F.array_position("probabilities", F.array_max("probabilities")) - 1).cast("int"))
