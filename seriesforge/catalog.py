"""Queries over the test tables and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as C
from .functions import kernels as K
from .functions import noise
from .functions.hydra import Hydra, SparseScaler, merged, moments
from .operators import dataset as D
from .operators import forest
from .operators import neighbours as N
from .operators import suite
from .plans import grids
from .sources import files
from .sources.scratch import new_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_SERIES = "s AS (SELECT vec_id AS series_id, CAST(label AS VARCHAR) AS label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"
_EVENTS = "s AS (SELECT user_id AS series_id, list(CAST(value AS DOUBLE) ORDER BY ts, event_id) AS v FROM events GROUP BY user_id)"
_PAIRS = _SERIES + ", p AS (SELECT x.series_id AS id_a, y.series_id AS id_b, x.v AS a, y.v AS b FROM s x JOIN s y ON y.series_id = x.series_id + 1)"
_SUM = "list_reduce({}, lambda acc, x: acc + x, 0.0::DOUBLE)"


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def _r(c: Column | str, digits: int = 6) -> Column:
    return F.round(c, digits)


# Transforms: (series_id, pos, value)

def _transform(name: str, fn: Callable[[Column], Column], sql: str, table=D.embedding_series, source: str = _SERIES) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return D.points(table(spark, sf_dir).withColumn("t", fn(F.col("values"))), "t").select("series_id", F.col("pos").cast("long").alias("pos"), _r("value").alias("value"))
    _add(name, query, f"WITH {source}, t AS (SELECT series_id, {sql} AS t FROM s) SELECT series_id, unnest(range(len(t))) AS pos, round(unnest(t), 6) AS value FROM t")


def _idx(body: str, length: str = "len(v)") -> str:
    return f"list_transform(range(1, {length} + 1), lambda i: {body})"


def _at(v: str, i: str) -> str:
    return f"{v}[CAST({i} AS INTEGER)]"


def _derive_sql(v: str) -> str:
    k = f"greatest(2, least(i, len({v}) - 1))"
    return f"list_transform(range(1, len({v}) + 1), lambda i: (({_at(v, k)} - {_at(v, k + ' - 1')}) + ({_at(v, k + ' + 1')} - {_at(v, k + ' - 1')}) / 2.0::DOUBLE) / 2.0::DOUBLE)"


_MEAN = f"({_SUM.format('v')} / len(v))"
_STD = f"sqrt(list_reduce(list_transform(v, lambda x: (x - {_MEAN}) * (x - {_MEAN})), lambda acc, x: acc + x, 0.0::DOUBLE) / (len(v) - 1))"
_transform("derivative", C.derivative, _derive_sql("v"), D.event_series, _EVENTS)
_add("derivative2", lambda s, d: D.points(D.embedding_series(s, d).withColumn("t", C.derivative(F.col("values"), 2)), "t").select("series_id", F.col("pos").cast("long").alias("pos"), _r("value").alias("value")),
     f"WITH {_SERIES}, t1 AS (SELECT series_id, {_derive_sql('v')} AS d FROM s), t AS (SELECT series_id, {_derive_sql('d')} AS t FROM t1) SELECT series_id, unnest(range(len(t))) AS pos, round(unnest(t), 6) AS value FROM t")
_transform("diff1", C.difference, "list_transform(range(2, len(v) + 1), lambda i: v[CAST(i AS INTEGER)] - v[CAST(i AS INTEGER) - 1])", D.event_series, _EVENTS)
_transform("minmax", C.minmax, "list_transform(v, lambda x: CASE WHEN list_min(v) = list_max(v) THEN 0.5::DOUBLE ELSE (x - list_min(v)) / (list_max(v) - list_min(v)) END)", D.event_series, _EVENTS)
_transform("percentile_minmax", C.percentile_minmax, "list_transform(v, lambda x: (x - list_sort(v)[CAST(floor(len(v) * 10 / 100.0) AS INTEGER) + 1]) / (list_sort(v)[least(CAST(floor(len(v) * 90 / 100.0) AS INTEGER), len(v) - 1) + 1] - list_sort(v)[CAST(floor(len(v) * 10 / 100.0) AS INTEGER) + 1]))")
_transform("meannorm", C.meannorm, f"list_transform(v, lambda x: (x - {_MEAN}) / (list_max(v) - list_min(v)))")
_transform("unitlength", C.unitlength, f"list_transform(v, lambda x: x / sqrt({_SUM.format('list_transform(v, lambda z: z * z)')}))")
_transform("zscore", C.zscore, f"list_transform(v, lambda x: (x - {_MEAN}) / {_STD})")
_transform("rescale", lambda v: C.rescale(v, 100), "list_transform(range(0, 100), lambda j: v[CAST(floor(j * len(v) / 100.0) AS INTEGER) + 1])", D.event_series, _EVENTS)
_transform("chop", lambda v: C.chop(v, 45), "v[1:45]", D.event_series, _EVENTS)
_transform("pad_zero", C.pad_zero, "list_concat(list_concat([0.0::DOUBLE], v), [0.0::DOUBLE])", D.event_series, _EVENTS)


def _interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    holes = D.event_series(spark, sf_dir).withColumn("t", C.interpolate(F.transform("values", lambda x, i: F.when(i % 5 < 2, F.lit(float("nan"))).otherwise(x))))
    return D.points(holes, "t").select("series_id", F.col("pos").cast("long").alias("pos"), _r("value").alias("value"))


_add("interpolate", _interpolate, f"""WITH {_EVENTS}, e AS (SELECT series_id, unnest(range(len(v))) AS pos, unnest(v) AS x FROM s),
h AS (SELECT series_id, pos, CASE WHEN pos % 5 >= 2 THEN x END AS x, CASE WHEN pos % 5 >= 2 THEN pos END AS kp FROM e),
f AS (SELECT *, last_value(x IGNORE NULLS) OVER before_ AS bx, last_value(kp IGNORE NULLS) OVER before_ AS bi, first_value(x IGNORE NULLS) OVER after_ AS ax, first_value(kp IGNORE NULLS) OVER after_ AS ai FROM h
  WINDOW before_ AS (PARTITION BY series_id ORDER BY pos ROWS UNBOUNDED PRECEDING), after_ AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT series_id, pos, round(CASE WHEN x IS NOT NULL THEN x WHEN bx IS NULL THEN ax WHEN ax IS NULL THEN bx ELSE bx + (ax - bx) * (pos - bi) / (ai - bi) END, 6) AS value FROM f""")

# Statistics and dataset operators
_add("series_stats", lambda s, d: D.series_stats(D.event_series(s, d)).select("series_id", F.col("length").cast("long").alias("length"), _r("min").alias("min"), _r("max").alias("max"), _r("mean").alias("mean"), _r("median").alias("median"), _r("stddev").alias("stddev"), "has_missing"),
     f"WITH {_EVENTS} SELECT series_id, len(v) AS length, round(list_min(v), 6) AS min, round(list_max(v), 6) AS max, round(list_avg(v), 6) AS mean, round(list_median(v), 6) AS median, round(list_stddev_samp(v), 6) AS stddev, false AS has_missing FROM s")
_add("split_stats", lambda s, d: D.split_stats(D.embedding_series(s, d), "values", "label").select("label", *[_r(c).alias(c) for c in ("min", "max", "mean", "stddev", "stddev_pop")]),
     f"WITH {_SERIES}, e AS (SELECT label, unnest(v) AS x FROM s) SELECT label, round(min(x), 6) AS min, round(max(x), 6) AS max, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS stddev, round(stddev_pop(x), 6) AS stddev_pop FROM e GROUP BY label")
_add("describe", lambda s, d: D.describe(D.embedding_series(s, d)).select(*[F.col(c).cast("long").alias(c) for c in ("size", "min_length", "max_length", "n_classes", "n_missing", "n_unlabelled")], "variable_length"),
     f"WITH {_SERIES} SELECT count(*) AS size, CAST(min(len(v)) AS BIGINT) AS min_length, CAST(max(len(v)) AS BIGINT) AS max_length, count(DISTINCT label) AS n_classes, 0::BIGINT AS n_missing, CAST(sum((label IS NULL)::INT) AS BIGINT) AS n_unlabelled, min(len(v)) <> max(len(v)) AS variable_length FROM s")
_add("label_encode", lambda s, d: D.encode_labels(D.embedding_series(s, d)).select("label", F.col("code").cast("long").alias("code")),
     f"WITH {_SERIES} SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS BIGINT) AS code FROM (SELECT DISTINCT label FROM s WHERE label IS NOT NULL)")


def _odd(series: DataFrame) -> DataFrame:
    return series.where(F.col("series_id") % 2 == 1)


_add("class_counts", lambda s, d: D.class_counts(D.embedding_series(s, d), D.embedding_series(s, d)), f"WITH {_SERIES} SELECT label, count(*) AS n FROM s GROUP BY label")
_add("by_class", lambda s, d: D.by_class(D.embedding_series(s, d)).select("label", F.explode("ids").alias("series_id")), f"WITH {_SERIES} SELECT label, series_id FROM s")
_add("gini", lambda s, d: D.gini(D.embedding_series(s, d).withColumn("branch", F.pmod(F.col("series_id"), F.lit(7)))
     , "branch").select("branch", "size", _r("gini").alias("gini")),
     f"WITH {_SERIES}, n AS (SELECT series_id % 7 AS branch, label, count(*) AS n FROM s GROUP BY ALL) SELECT branch, CAST(sum(n) AS BIGINT) AS size, round(CASE WHEN sum(n) <= 1 THEN 0.0::DOUBLE ELSE 1 - sum(n * n) / (sum(n) * sum(n))::DOUBLE END, 6) AS gini FROM n GROUP BY branch")
_add("weighted_gini", lambda s, d: D.weighted_gini(D.embedding_series(s, d).withColumn("branch", F.pmod(F.col("series_id"), F.lit(7))), "branch").select(_r("weighted_gini").alias("weighted_gini")),
     f"WITH {_SERIES}, n AS (SELECT series_id % 7 AS branch, label, count(*) AS n FROM s GROUP BY ALL), g AS (SELECT branch, sum(n) AS size, 1 - sum(n * n) / (sum(n) * sum(n))::DOUBLE AS gini FROM n GROUP BY branch) SELECT round(sum(size * gini) / sum(size), 6) AS weighted_gini FROM g")
_add("pick_one_by_class", lambda s, d: D.pick_one_by_class(D.embedding_series(s, d), 42), f"WITH {_SERIES} SELECT label, arg_min(series_id, md5('42:' || series_id)) AS series_id FROM s GROUP BY label")
_add("stratified_sample", lambda s, d: D.stratified_sample(D.embedding_series(s, d), 0.3, 42),
     f"WITH {_SERIES}, r AS (SELECT label, series_id, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || series_id), series_id) AS k, count(*) OVER (PARTITION BY label) AS n FROM s) SELECT series_id, label FROM r WHERE k <= ceil(0.3::DOUBLE * n)")
_add("duplicates", lambda s, d: D.duplicates(D.embedding_series(s, d).withColumn("values", F.transform("values", lambda x: F.signum(F.floor(x * 3))))).select(F.explode("ids").alias("series_id")),
     f"WITH {_SERIES}, g AS (SELECT list(series_id) AS ids FROM s GROUP BY list_transform(v, lambda x: sign(floor(x * 3)))) SELECT unnest(ids) AS series_id FROM g WHERE len(ids) > 1")
_add("wdtw_weights", lambda s, d: s.range(1).select(F.posexplode(C.wdtw_weights(0.05, 64)).alias("pos", "w")).select(F.col("pos").cast("long").alias("pos"), _r("w").alias("w")),
     "SELECT i AS pos, round(1.0::DOUBLE / (1.0::DOUBLE + exp(-0.05::DOUBLE * (i - 32.0::DOUBLE))), 6) AS w FROM range(64) t(i)")

# Lockstep distances and bounds of consecutive series


def _pairs(name: str, value: Callable[[Column, Column], Column], sql: str) -> None:
    _add(name, lambda s, d: N.consecutive_pairs(D.embedding_series(s, d)).select("id_a", "id_b", _r(value(F.col("a"), F.col("b"))).alias("d")),
         f"WITH {_PAIRS} SELECT id_a, id_b, round({sql}, 6) AS d FROM p")


def _zip_sum(cost: str) -> str:
    return _SUM.format(f"list_transform(range(1, len(a) + 1), lambda i: {cost.replace('#a', 'a[CAST(i AS INTEGER)]').replace('#b', 'b[CAST(i AS INTEGER)]')})")


_pairs("directa_1", lambda a, b: C.directa(a, b, 1), _zip_sum("abs(#a - #b)"))
_pairs("directa_2", lambda a, b: C.directa(a, b, 2), _zip_sum("(#a - #b) * (#a - #b)"))
_pairs("directa_05", lambda a, b: C.directa(a, b, 0.5), _zip_sum("sqrt(abs(#a - #b))"))
_pairs("directa_15", lambda a, b: C.directa(a, b, 1.5), _zip_sum("pow(abs(#a - #b), 1.5)"))
_pairs("minkowski", lambda a, b: C.minkowski(a, b, 3.0), f"pow({_zip_sum('pow(abs(#a - #b), 3.0)')}, 1.0 / 3.0::DOUBLE)")
_pairs("manhattan", C.manhattan, _zip_sum("abs(#a - #b)"))
_pairs("lorentzian", C.lorentzian, _zip_sum("ln(1 + abs(#a - #b))"))
_ENV = "{f}(b[greatest(CAST(i AS INTEGER) - 5, 1):CAST(i AS INTEGER) + 5])"
_KEOGH = _zip_sum(f"CASE WHEN #a > {_ENV.format(f='list_max')} THEN (#a - {_ENV.format(f='list_max')}) * (#a - {_ENV.format(f='list_max')}) WHEN #a < {_ENV.format(f='list_min')} THEN (#a - {_ENV.format(f='list_min')}) * (#a - {_ENV.format(f='list_min')}) ELSE 0.0::DOUBLE END")
_pairs("lb_keogh", lambda a, b: C.lb_keogh(a, b, 5), _KEOGH)
_add("lb_keogh2j", lambda s, d: N.consecutive_pairs(D.embedding_series(s, d)).select("id_a", "id_b", _r(C.lb_keogh2j(F.col("a"), F.col("b"), 5)).alias("d")),
     f"WITH {_PAIRS}, k AS (SELECT id_a, id_b, {_KEOGH} AS x FROM p UNION ALL SELECT id_a, id_b, {_KEOGH} AS x FROM (SELECT id_a, id_b, b AS a, a AS b FROM p)) SELECT id_a, id_b, round(max(x), 6) AS d FROM k GROUP BY ALL")
_add("envelopes", lambda s, d: D.embedding_series(s, d).select("series_id", F.posexplode(F.arrays_zip(C.envelope(F.col("values"), 5).alias("u"), C.envelope(F.col("values"), 5, False).alias("l"))).alias("pos", "e"))
     .select("series_id", F.col("pos").cast("long").alias("pos"), _r("e.u").alias("upper"), _r("e.l").alias("lower")),
     f"WITH {_SERIES}, e AS (SELECT series_id, unnest(range(len(v))) AS pos, unnest(v) AS x FROM s) SELECT series_id, pos, round(max(x) OVER w, 6) AS upper, round(min(x) OVER w, 6) AS lower FROM e WINDOW w AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)")

# Elastic distances of consecutive series: numpy kernels against a recursive query that fills the matrix row by row


def _elastic(name: str, kernel: str, params: dict, new: str, row0: str = "'inf'::DOUBLE", col0: str = "'inf'::DOUBLE", final: str = "q[len(b) + 1]", extra: str = "") -> None:
    """new: cell from l, d, t (left, diagonal, top), i, j (1-based), x, y (points).  row0: first row at j; col0: first column at i."""
    cell = new
    for k, v in (("#l", "acc[len(acc)]"), ("#d", "q[len(acc)]"), ("#t", "q[len(acc) + 1]"), ("#x", "a[i]"), ("#px", "(CASE WHEN i > 1 THEN a[i - 1] ELSE 0.0::DOUBLE END)"),
                 ("#y", "b[len(acc)]"), ("#py", "(CASE WHEN len(acc) > 1 THEN b[len(acc) - 1] ELSE 0.0::DOUBLE END)"), ("#j", "len(acc)")):
        cell = cell.replace(k, v)
    first = f"list_transform(range(0, len(b) + 1), lambda j: CASE WHEN j = 0 THEN 0.0::DOUBLE ELSE {row0} END)"
    sql = f"""WITH RECURSIVE {_PAIRS}{extra}, f(id_a, id_b, a, b, i, q) AS (SELECT id_a, id_b, a, b, 1, {first} FROM p
UNION ALL SELECT id_a, id_b, a, b, i + 1, list_reduce(list_transform(b, lambda z: [z]), lambda acc, z: list_append(acc, CAST({cell} AS DOUBLE)), [CAST({col0} AS DOUBLE)]) FROM f WHERE i <= len(a))
SELECT id_a, id_b, round({final}, 6) AS d FROM f WHERE i = len(a) + 1"""
    _add(name, lambda s, d: N.consecutive_pairs(D.embedding_series(s, d)).select("id_a", "id_b", _r(N.distance(kernel, F.col("a"), F.col("b"), **params)).alias("d")), sql)


_C2 = "(#x - #y) * (#x - #y)"
_elastic("dtw", "dtw", {}, f"least(#l, #d, #t) + {_C2}")
_elastic("dtw_e1", "dtw", {"cfe": 1.0}, "least(#l, #d, #t) + abs(#x - #y)")
_elastic("cdtw", "dtw", {"window": 6}, f"CASE WHEN abs(i - #j) > 6 THEN 'inf'::DOUBLE ELSE least(#l, #d, #t) + {_C2} END")
_elastic("adtw", "adtw", {"penalty": 0.5}, f"least(#d + {_C2}, least(#l, #t) + {_C2} + 0.5)")
_elastic("wdtw", "wdtw", {"g": 0.05}, f"least(#l, #d, #t) + {_C2} * (1.0 / (1.0 + exp(-0.05::DOUBLE * (abs(i - #j) - 32.0))))")
_elastic("erp", "erp", {"gap": 0.2}, f"least(#d + {_C2}, #l + (#y - 0.2) * (#y - 0.2), #t + (#x - 0.2) * (#x - 0.2))",
         "list_reduce(list_transform(b[1:CAST(j AS INTEGER)], lambda z: (z - 0.2) * (z - 0.2)), lambda u, z: u + z, 0.0::DOUBLE)", "list_reduce(list_transform(a[1:i], lambda z: (z - 0.2) * (z - 0.2)), lambda u, z: u + z, 0.0::DOUBLE)")
_elastic("lcss", "lcss", {"epsilon": 0.3, "window": 8}, "CASE WHEN abs(i - #j) > 8 THEN 0.0::DOUBLE WHEN abs(#x - #y) < 0.3 THEN #d + 1 ELSE greatest(#l, #d, #t) END", "0.0::DOUBLE", "0.0::DOUBLE", "1 - q[len(b) + 1] / least(len(a), len(b))")
_MOVE = "(CASE WHEN ({p} <= {n} AND {n} <= {o}) OR ({p} >= {n} AND {n} >= {o}) THEN 0.5::DOUBLE ELSE 0.5 + least(abs({n} - {p}), abs({n} - {o})) END)"
_elastic("msm", "msm", {"cost": 0.5}, f"least(#d + abs(#x - #y), #t + {_MOVE.format(n='#x', p='#px', o='#y')}, #l + {_MOVE.format(n='#y', p='#py', o='#x')})")
_elastic("twe", "twe", {"nu": 0.01, "lam": 0.1}, "least(#d + (#x - #y) * (#x - #y) + (#px - #py) * (#px - #py) + 0.02 * abs(i - #j), #t + (#x - #px) * (#x - #px) + 0.11, #l + (#y - #py) * (#y - #py) + 0.11)")
_pairs("sbd", lambda a, b: N.distance("sbd", a, b), f"1 - list_max(list_transform(range(-63, 64), lambda k: {_SUM.format('list_transform(range(greatest(1, 1 + k), least(64, 64 + k) + 1), lambda i: a[CAST(i AS INTEGER)] * b[CAST(i - k AS INTEGER)])')})) / "
       f"(sqrt({_SUM.format('list_transform(a, lambda z: z * z)')}) * sqrt({_SUM.format('list_transform(b, lambda z: z * z)')}))")

_SQ = "({0} - {1}) * ({0} - {1})"
_END = "list_min(list_transform({r}, lambda j: least({x}, {y})))"
_BANDS = (_SQ.format("a[1]", "b[1]") + " + " + _SQ.format("a[64]", "b[64]") + " + " + _SUM.format("list_transform(range(1, 5), lambda i: "
          + _END.format(r="range(greatest(0, i - 5), i + 1)", x=_SQ.format(_at("a", "j + 1"), _at("b", "i + 1")), y=_SQ.format(_at("a", "i + 1"), _at("b", "j + 1"))) + " + "
          + _END.format(r="range(63 - i, least(64, 69 - i))", x=_SQ.format(_at("a", "j + 1"), _at("b", "64 - i")), y=_SQ.format(_at("a", "64 - i"), _at("b", "j + 1"))) + ")"))
_ENHANCED = f"{_BANDS} + {_KEOGH.replace('range(1, len(a) + 1)', 'range(6, 60)')}"
_SWAPPED = f"k AS (SELECT id_a, id_b, {_ENHANCED} AS x FROM p UNION ALL SELECT id_a, id_b, {_ENHANCED} AS x FROM (SELECT id_a, id_b, b AS a, a AS b FROM p))"
_BOUND_SQL = {"lb_enhanced": f"WITH {_PAIRS} SELECT id_a, id_b, round({_ENHANCED}, 6) AS d FROM p", "lb_enhanced2j": f"WITH {_PAIRS}, {_SWAPPED} SELECT id_a, id_b, round(max(x), 6) AS d FROM k GROUP BY ALL"}
for _name in ("lb_enhanced", "lb_enhanced2j", "lb_webb"):
    _add(_name, lambda s, d, k=_name: N.consecutive_pairs(D.embedding_series(s, d)).select("id_a", "id_b", _r(N.distance(k, F.col("a"), F.col("b"), window=5)).alias("d")), _BOUND_SQL.get(_name))


def _dtw_wr(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("cost double, max_deviation long")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        cost, dev = K.dtw_wr(np.array(list(a)), np.array(list(b)), 2.0, 10)
        return pd.DataFrame({"cost": cost, "max_deviation": dev})
    return N.consecutive_pairs(D.embedding_series(spark, sf_dir)).select("id_a", "id_b", run("a", "b").alias("r")).select("id_a", "id_b", _r("r.cost").alias("cost"), "r.max_deviation")


_add("dtw_wr", _dtw_wr)

# Nearest neighbours
_ED = f"WITH {_SERIES}, d AS (SELECT x.series_id, x.label, y.series_id AS nn_id, y.label AS nn_label, list_reduce(list_transform(list_zip(x.v, y.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda acc, z: acc + z, 0.0::DOUBLE) AS dist FROM s x JOIN s y ON x.series_id <> y.series_id)"
_add("nn1_ed", lambda s, d: N.nearest(D.embedding_series(s, d), D.embedding_series(s, d), exclude_self=True).select("series_id", "label", "nn_id", "nn_label", _r("nn_dist").alias("nn_dist")),
     _ED + " SELECT series_id, any_value(label) AS label, arg_min(nn_id, struct_pack(d := dist, i := nn_id)) AS nn_id, arg_min(nn_label, struct_pack(d := dist, i := nn_id)) AS nn_label, round(min(dist), 6) AS nn_dist FROM d GROUP BY series_id")
_add("nn1_accuracy", lambda s, d: N.accuracy(N.classify(D.embedding_series(s, d), D.embedding_series(s, d), "directa", {}, True)).select("n", "n_correct", _r("accuracy").alias("accuracy")),
     _ED + ", n AS (SELECT series_id, any_value(label) AS label, arg_min(nn_label, struct_pack(d := dist, i := nn_id)) AS nn_label FROM d GROUP BY series_id) SELECT count(*) AS n, CAST(sum((label = nn_label)::INT) AS BIGINT) AS n_correct, round(avg((label = nn_label)::INT), 6) AS accuracy FROM n")
_add("loocv_ed", lambda s, d: N.loocv(D.embedding_series(s, d), "directa", [{"cfe": 1.0}, {"cfe": 2.0}]),
     f"""WITH {_SERIES}, z AS (SELECT x.series_id, x.label, y.series_id AS nn_id, y.label AS nn_label, list_transform(list_zip(x.v, y.v), lambda z: z[1] - z[2]) AS g FROM s x JOIN s y ON x.series_id <> y.series_id),
d AS (SELECT *, 0 AS param, {_SUM.format('list_transform(g, lambda u: abs(u))')} AS dist FROM z UNION ALL SELECT *, 1, {_SUM.format('list_transform(g, lambda u: u * u)')} FROM z),
n AS (SELECT param, series_id, any_value(label) AS label, arg_min(nn_label, struct_pack(d := dist, i := nn_id)) AS nn_label FROM d GROUP BY param, series_id),
e AS (SELECT param, CAST(sum((label <> nn_label)::INT) AS BIGINT) AS errors FROM n GROUP BY param) SELECT param, errors, errors = (SELECT min(errors) FROM e) AS best FROM e""")
_add("nn1_cdtw", lambda s, d: N.nearest_pruned(*[D.embedding_series(s, d)] * 2, 3, exclude_self=True).select("series_id", "label", "nn_id", "nn_label", _r("nn_dist").alias("nn_dist")))
_add("loocv_cdtw", lambda s, d: N.loocv(D.embedding_series(s, d), "dtw", [{"window": w} for w in (0, 2, 4)]))



def _ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest of rounded series, among which many are equally near."""
    series = D.embedding_series(spark, sf_dir).withColumn("values", F.transform(F.slice("values", 1, 3), lambda x: F.floor(x * 4).cast("double")))
    return N.nearest_counts(series, series, exclude_self=True).select("series_id", "label", "nn_label", "n", _r("nn_dist").alias("nn_dist"))


_add("nn1_ties", _ties, f"""WITH {_SERIES}, r AS (SELECT series_id, label, list_transform(v[1:3], lambda x: floor(x * 4)) AS v FROM s),
d AS (SELECT x.series_id, x.label, y.label AS nn_label, {_SUM.format('list_transform(list_zip(x.v, y.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))')} AS dist FROM r x JOIN r y ON x.series_id <> y.series_id),
m AS (SELECT series_id, min(dist) AS least FROM d GROUP BY series_id)
SELECT d.series_id, d.label, nn_label, count(*) AS n, round(least, 6) AS nn_dist FROM d JOIN m ON d.series_id = m.series_id AND dist = least GROUP BY d.series_id, d.label, nn_label, least""")
_add("direct_cost_sample", lambda s, d: suite.direct_cost(D.embedding_series(s, d), [0.5, 1, 2], seed=42).select("cfe", _r("mean_cost").alias("mean_cost")),
     f"""WITH {_SERIES}, k AS (SELECT row_number() OVER (ORDER BY series_id) - 1 AS k, v FROM s),
z AS (SELECT count(*) AS n FROM s), u AS (SELECT n, CAST('0x' || substr(md5('42:x:' || i), 1, 8) AS BIGINT) % n AS x, CAST('0x' || substr(md5('42:y:' || i), 1, 8) AS BIGINT) % (n - 1) AS h FROM range({suite.PAIRS}) t(i), z),
w AS (SELECT x, (x + 1 + h) % n AS y FROM u),
p AS (SELECT ka.v AS a, kb.v AS b FROM w JOIN k ka ON ka.k = w.x JOIN k kb ON kb.k = w.y)
SELECT 0.5::DOUBLE AS cfe, round(avg({_zip_sum('sqrt(abs(#a - #b))')}), 6) AS mean_cost FROM p UNION ALL SELECT 1, round(avg({_zip_sum('abs(#a - #b)')}), 6) FROM p UNION ALL SELECT 2, round(avg({_zip_sum('(#a - #b) * (#a - #b)')}), 6) FROM p""")


def _suite(name: str) -> Query:
    """Even ids train, odd ids test: the chosen parameter set, and how test does with it."""
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        series = D.embedding_series(spark, sf_dir)
        best, _, found = suite.search(series.where("series_id % 2 = 0"), series.where("series_id % 2 = 1"), name)
        return N.accuracy(found).select(F.lit(best).cast("long").alias("param"), "n", "n_correct", _r("accuracy").alias("accuracy"))
    return query


def _suite_sql(exponents: list[float], derive: bool = False) -> str:
    """Search over exponents of the direct distance, then the test half; ties by the class counts."""
    rows = " UNION ALL ".join(f"SELECT {p} AS param, {e}::DOUBLE AS e" for p, e in enumerate(exponents))
    start = _SERIES.replace("s AS", "s0 AS", 1) + f", s AS (SELECT series_id, label, {_derive_sql('v')} AS v FROM s0)" if derive else _SERIES
    dist = _SUM.format("list_transform(list_zip(x.v, y.v), lambda z: pow(abs(z[1] - z[2]), e))")
    return f"""WITH {start}, g AS ({rows}),
d AS (SELECT param, x.series_id, x.label, y.series_id AS nn_id, y.label AS nn_label, {dist} AS dist FROM s x JOIN s y ON x.series_id <> y.series_id AND x.series_id % 2 = 0 AND y.series_id % 2 = 0 CROSS JOIN g),
f AS (SELECT param, series_id, any_value(label) AS label, arg_min(nn_label, struct_pack(d := dist, i := nn_id)) AS nn_label FROM d GROUP BY param, series_id),
b AS (SELECT param FROM f GROUP BY param ORDER BY sum((label <> nn_label)::INT), param LIMIT 1),
t AS (SELECT param, x.series_id, x.label, y.label AS nn_label, {dist} AS dist FROM s x JOIN s y ON x.series_id % 2 = 1 AND y.series_id % 2 = 0 CROSS JOIN (SELECT param, e FROM g JOIN b USING (param))),
c AS (SELECT param, series_id, label, nn_label, count(*) AS n FROM t WHERE dist = (SELECT min(dist) FROM t u WHERE u.series_id = t.series_id) GROUP BY ALL),
v AS (SELECT param, series_id, label, arg_min(nn_label, struct_pack(m := -n, l := nn_label)) AS nn_label FROM c GROUP BY ALL)
SELECT any_value(param)::BIGINT AS param, count(*) AS n, CAST(sum((label = nn_label)::INT) AS BIGINT) AS n_correct, round(avg((label = nn_label)::INT), 6) AS accuracy FROM v"""


_add("suite_ed", _suite("ED1NN"), _suite_sql([2.0]))
_add("suite_minkowski", _suite("Minkowski1NN"), _suite_sql(grids.PLUS_EXPONENTS))
_add("suite_d1_minkowski", _suite("d1-Minkowski1NN-1.0"), _suite_sql([1.0], derive=True))


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per class: size, statistics over all points, direct costs of consecutive series by exponent."""
    series = D.embedding_series(spark, sf_dir)
    pair = N.consecutive_pairs(series).join(series.select(F.col("series_id").alias("id_a"), "label"), "id_a")
    cost = pair.groupBy("label").agg(*[_r(F.avg(C.directa(F.col("a"), F.col("b"), e))).alias(f"mean_{n}") for e, n in ((1, "1"), (2, "2"), (0.5, "05"))])
    stats = D.split_stats(series, "values", "label").select("label", _r("mean").alias("mean"), _r("stddev").alias("stddev"))
    return D.class_counts(series, series).join(stats, "label").join(cost, "label", "left")


_add("profile", _profile, f"""WITH {_PAIRS}, e AS (SELECT label, unnest(v) AS x FROM s), st AS (SELECT label, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS stddev FROM e GROUP BY label),
c AS (SELECT s.label, round(avg({_zip_sum('abs(#a - #b)')}), 6) AS mean_1, round(avg({_zip_sum('(#a - #b) * (#a - #b)')}), 6) AS mean_2, round(avg({_zip_sum('sqrt(abs(#a - #b))')}), 6) AS mean_05 FROM p JOIN s ON s.series_id = p.id_a GROUP BY s.label)
SELECT n.label, n.n, st.mean, st.stddev, c.mean_1, c.mean_2, c.mean_05 FROM (SELECT label, count(*) AS n FROM s GROUP BY label) n JOIN st USING (label) LEFT JOIN c USING (label)""")

# Sampling, votes, probabilities, grids and round trips


def _ts_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "ts")
    files.write_ts(D.embedding_series(spark, sf_dir), path, "embeddings")
    return D.points(files.read_ts(spark, path)[0], "values", "label").select("label", F.col("pos").cast("long").alias("pos"), _r("value").alias("value"))


def _csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "csv")
    D.event_series(spark, sf_dir).select(F.concat_ws(",", F.col("series_id").cast("string"), F.transform("values", lambda x: x.cast("string")))).write.text(path)
    return D.points(files.read_csv(spark, path), "values", "label").select(F.col("label").cast("long").alias("label"), F.col("pos").cast("long").alias("pos"), _r("value").alias("value"))


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = grids.by_name("d1-ED1NN")
    series = D.with_transform(D.embedding_series(spark, sf_dir), "values", C.derivative)
    found = N.nearest(series, series, c["distance"], [c["params"]], exclude_self=True)
    return found.select("series_id", "nn_id", _r("nn_dist").alias("nn_dist"))


def _halves(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Even and odd ids, each numbered from 0."""
    series = D.embedding_series(spark, sf_dir)
    return [D.numbered(series.where(F.col("series_id") % 2 == half)) for half in (0, 1)]


def _group(series: DataFrame) -> DataFrame:
    return series.withColumn("series_id", F.pmod("series_id", F.lit(40)))


def _grid(grid: list[dict]) -> Query:
    names = sorted(grid[0])

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = [(i, *[float(g[n]) for n in names]) for i, g in enumerate(grid)]
        return spark.createDataFrame(rows, "param long, " + ", ".join(f"{n} double" for n in names)).select("param", *[_r(n).alias(n) for n in names])
    return query


_add("ts_round_trip", _ts_round_trip, f"WITH {_SERIES} SELECT label, unnest(range(len(v))) AS pos, round(unnest(v), 6) AS value FROM s")
_add("csv_round_trip", _csv_round_trip, f"WITH {_EVENTS} SELECT series_id AS label, unnest(range(len(v))) AS pos, round(unnest(v), 6) AS value FROM s")
_add("stratified_subset", lambda s, d: D.stratified_subset(D.embedding_series(s, d), 0.2, 5, 42).select("series_id", "label"),
     f"WITH {_SERIES}, r AS (SELECT label, series_id, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || series_id)) AS k FROM s) SELECT series_id, label FROM r ORDER BY k, label LIMIT (SELECT greatest(CAST(floor(0.2 * count(*)) AS BIGINT), 5) FROM s)")
_add("bag", lambda s, d: D.bag(D.embedding_series(s, d), 50, 42).select("series_id"), f"WITH {_SERIES} SELECT series_id FROM s ORDER BY md5('42:' || series_id) LIMIT 50")
_add("first_seen_labels", lambda s, d: D.first_seen_labels(D.embedding_series(s, d), "series_id").select("label", F.col("code").cast("long").alias("code")),
     f"WITH {_SERIES} SELECT label, CAST(row_number() OVER (ORDER BY min(series_id), label) - 1 AS BIGINT) AS code FROM s GROUP BY label")
# The train side of a fold whose test ids are the multiples of three.
_add("fold_train", lambda s, d: D.complement(D.embedding_series(s, d), D.embedding_series(s, d).where("series_id % 3 = 0")).select("series_id", "label"),
     f"WITH {_SERIES} SELECT series_id, label FROM s WHERE series_id % 3 <> 0")
_add("majority_vote", lambda s, d: N.majority_vote(_group(D.embedding_series(s, d)).select("series_id", "label")).select("series_id", "label", "n"),
     f"WITH {_SERIES}, n AS (SELECT series_id % 40 AS series_id, label, count(*) AS n FROM s GROUP BY ALL) SELECT series_id, arg_min(label, struct_pack(m := -n, l := label)) AS label, max(n) AS n FROM n GROUP BY series_id")
_add("weighted_average", lambda s, d: D.points(N.weighted_average(_group(D.embedding_series(s, d).withColumn("weight", F.lit(1.0) + F.col("series_id") % 5)).select("series_id", F.slice("values", 1, 4).alias("probabilities"), "weight")), "probabilities")
     .select("series_id", F.col("pos").cast("long").alias("pos"), _r("value").alias("value")),
     f"WITH {_SERIES}, e AS (SELECT series_id % 40 AS series_id, 1 + series_id % 5 AS w, unnest(range(4)) AS pos, unnest(v[1:4]) AS p FROM s) SELECT series_id, pos, round(sum(p * w) / sum(w), 6) AS value FROM e GROUP BY series_id, pos")
_add("smooth_probabilities", lambda s, d: D.class_counts(D.embedding_series(s, d), D.embedding_series(s, d)).select("label", F.posexplode(C.smooth_probabilities(F.col("n"), 4, 1)).alias("pos", "value"))
     .select("label", F.col("pos").cast("long").alias("pos"), _r("value").alias("value")),
     f"WITH {_SERIES}, n AS (SELECT label, count(*) AS n FROM s GROUP BY label) SELECT label, pos, round((1 + CASE WHEN pos = 1 THEN n ELSE 0 END)::DOUBLE / (4 + n), 6) AS value FROM n, range(4) t(pos)")
_add("most_probable", lambda s, d: D.embedding_series(s, d).select("series_id", F.explode(C.most_probable(F.transform("values", lambda x: F.floor(x * 4).cast("double")))).alias("pos")).select("series_id", F.col("pos").cast("long").alias("pos")),
     f"WITH {_SERIES}, e AS (SELECT series_id, unnest(range(len(v))) AS pos, floor(unnest(v) * 4) AS x FROM s), m AS (SELECT *, max(x) OVER (PARTITION BY series_id) AS top FROM e) SELECT series_id, pos FROM m WHERE x = top")
_add("nn1_d1_ed", _named, _ED.replace(_SERIES, _SERIES.replace("s AS", "s0 AS", 1) + f", s AS (SELECT series_id, label, {_derive_sql('v')} AS v FROM s0)")
     + " SELECT series_id, arg_min(nn_id, struct_pack(d := dist, i := nn_id)) AS nn_id, round(min(dist), 6) AS nn_dist FROM d GROUP BY series_id")
_EVENT_PAIRS = _EVENTS + ", p AS (SELECT x.series_id AS id_a, y.series_id AS id_b, x.v AS a, y.v AS b FROM s x JOIN s y ON y.series_id = x.series_id + 1)"
_add("ed_prefix", lambda s, d: N.consecutive_pairs(D.event_series(s, d)).select("id_a", "id_b", _r(N.distance("ed_prefix", F.col("a"), F.col("b"))).alias("d")),
     f"WITH {_EVENT_PAIRS} SELECT id_a, id_b, round({_SUM.format('list_transform(range(1, least(len(a), len(b)) + 1), lambda i: pow(a[CAST(i AS INTEGER)] - b[CAST(i AS INTEGER)], 2))')}, 6) AS d FROM p")
_CC = f"list_max(list_transform(range(-63, 64), lambda k: {_SUM.format('list_transform(range(greatest(1, 1 + k), least(64, 64 + k) + 1), lambda i: a[CAST(i AS INTEGER)] * b[CAST(i - k AS INTEGER)])')}))"
_NORMS = f"(sqrt({_SUM.format('list_transform(a, lambda z: z * z)')}) * sqrt({_SUM.format('list_transform(b, lambda z: z * z)')}))"
for _name, _sql in (("max_cc", _CC), ("max_ncc_b", f"{_CC} / 64"), ("max_ncc_c", f"{_CC} / {_NORMS}")):
    _pairs(_name, lambda a, b, k=_name: N.distance(k, a, b), _sql)


def _cc_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("array<double>")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([K.cross_correlation(np.array([x], float), np.array([y], float))[0] for x, y in zip(a, b)])
    lags = N.consecutive_pairs(D.embedding_series(spark, sf_dir)).select("id_a", "id_b", F.posexplode(run("a", "b")).alias("pos", "value"))
    return lags.select("id_a", "id_b", (F.col("pos") - 63).cast("long").alias("lag"), _r("value").alias("value"))


_add("cc_seq", _cc_seq, f"WITH {_PAIRS}, l AS (SELECT id_a, id_b, a, b, unnest(range(-63, 64)) AS k FROM p) SELECT id_a, id_b, k AS lag, "
     f"round({_SUM.format('list_transform(range(greatest(1, 1 + k), least(64, 64 + k) + 1), lambda i: a[CAST(i AS INTEGER)] * b[CAST(i - k AS INTEGER)])')}, 6) AS value FROM l")
_add("class_probabilities", lambda s, d: D.class_probabilities(D.embedding_series(s, d)).select("label", "n", _r("p").alias("p")),
     f"WITH {_SERIES}, n AS (SELECT label, count(*) AS n FROM s GROUP BY label) SELECT label, n, round(n / (sum(n) OVER ())::DOUBLE, 6) AS p FROM n")
_add("diff2", lambda s, d: D.points(D.event_series(s, d).withColumn("t", C.difference(F.col("values"), 2)), "t").select("series_id", F.col("pos").cast("long").alias("pos"), _r("value").alias("value")),
     f"WITH {_EVENTS}, t AS (SELECT series_id, list_transform(range(3, len(v) + 1), lambda i: (v[CAST(i AS INTEGER)] - v[CAST(i AS INTEGER) - 1]) - (v[CAST(i AS INTEGER) - 1] - v[CAST(i AS INTEGER) - 2])) AS t FROM s) "
     "SELECT series_id, unnest(range(len(t))) AS pos, round(unnest(t), 6) AS value FROM t")
_add("stratified_copies", lambda s, d: D.stratified_sample(D.embedding_series(s, d), 1.3, 42),
     f"WITH {_SERIES}, r AS (SELECT label, series_id, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || series_id), series_id) AS k, count(*) OVER (PARTITION BY label) AS n FROM s) "
     "SELECT series_id, label FROM r UNION ALL SELECT series_id, label FROM r WHERE k <= ceil((1.3::DOUBLE - 1) * n)")
# Positions of a fold over train (even ids) and test (odd ids): below the size of train they refer to train.
_add("resample", lambda s, d: files.resample(*_halves(s, d), s.range(0, 400, 3).withColumnRenamed("id", "position")).select("series_id", "label"),
     f"WITH {_SERIES}, r AS (SELECT label, row_number() OVER (PARTITION BY series_id % 2 ORDER BY series_id) - 1 AS k, series_id % 2 AS half FROM s), "
     "m AS (SELECT k + CASE WHEN half = 1 THEN (SELECT count(*) FROM r WHERE half = 0) ELSE 0 END AS series_id, label FROM r) SELECT series_id, label FROM m WHERE series_id < 400 AND series_id % 3 = 0")


def _resample_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third position over train and test, as many as the table has."""
    train, test = _halves(spark, sf_dir)
    every = spark.range(0, train.count() + test.count(), 3).withColumnRenamed("id", "position")
    return files.resample(train, test, every).select("series_id", "label")


_add("resample_whole", _resample_whole,
     f"WITH {_SERIES}, r AS (SELECT label, row_number() OVER (PARTITION BY series_id % 2 ORDER BY series_id) - 1 AS k, series_id % 2 AS half FROM s), "
     "m AS (SELECT k + CASE WHEN half = 1 THEN (SELECT count(*) FROM r WHERE half = 0) ELSE 0 END AS series_id, label FROM r) SELECT series_id, label FROM m WHERE series_id % 3 = 0")
_add("cdtw_grid", _grid(grids.cdtw_grid(64)), "SELECT i AS param, 2.0::DOUBLE AS cfe, ceil(i / 100.0::DOUBLE * 64) AS \"window\" FROM range(100) t(i)")
_add("adtw_grid", _grid(grids.adtw_grid({1.0: 40.0, 2.0: 30.0})),
     "SELECT k * 100 + i - 1 AS param, k + 1.0::DOUBLE AS cfe, round((40 - 10 * k) * pow(0.01::DOUBLE * i, 5), 6) AS penalty FROM range(2) u(k), range(1, 101) t(i)")
_add("lcss_grid", _grid(grids.lcss_grid(64, 1.5)),
     "SELECT p AS param, floor((p % 10) * 16.25::DOUBLE / 9) AS \"window\", round(0.3::DOUBLE + (p // 10) * 1.2::DOUBLE / 9, 6) AS epsilon FROM range(100) t(p)")
_add("minkowski_grid", _grid(grids.minkowski_grid()), "SELECT param, cfe FROM (VALUES (0::BIGINT, 1.0::DOUBLE), (1, 1.5), (2, 0.666666), (3, 2.0), (4, 0.5)) t(param, cfe)")

# Seeded and learned operators: no SQL
_add("noise", lambda s, d: D.embedding_series(s, d).select("series_id", noise.add_noise(F.col("series_id"), F.col("values"), 0.1, 7).alias("values")))
_add("pad_suffix_noise", lambda s, d: D.event_series(s, d).select("series_id", noise.pad_suffix_noise(F.col("series_id"), F.col("values"), 120, 7).alias("values")))
_add("pad_both_noise", lambda s, d: D.event_series(s, d).select("series_id", noise.pad_both_noise(F.col("series_id"), F.col("values"), 120, 7).alias("values")))


CHUNK, MERGERS = 64, 16


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.Series, np.ndarray]]:
    """Ids and values of few series at a time: their windows and features are many times as large."""
    for b in batches:
        for at in range(0, len(b), CHUNK):
            part = b.iloc[at:at + CHUNK]
            yield part["series_id"], np.array(part["values"].tolist())


def _hydra(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = Hydra(64, seed=1)

    def run(batches):
        for ids, values in _chunks(batches):
            yield pd.DataFrame({"series_id": ids, "features": list(model.transform(values))})
    return D.embedding_series(spark, sf_dir).select("series_id", "values").mapInPandas(run, "series_id long, features array<double>")


def _forest(preset: str, **options) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        series = D.embedding_series(spark, sf_dir)
        codes = D.encode_labels(series)
        model = forest.fit(series, codes, n_trees=8, candidates=2, splitters=preset, seed=3, sample=1.0, adtw_pairs=4000, **options)
        return forest.predict(model, series).select("series_id", "predicted")
    return query


def _fitted(series: DataFrame, model: Hydra) -> SparseScaler:
    """A scaler of the features of all series: moments of each partition, merged in MERGERS tasks, whose rows meet here."""
    schema = "n long, mean array<double>, squares array<double>, zeros array<double>"

    def fold(parts: Iterator[tuple]) -> Iterator[pd.DataFrame]:
        total = None
        for part in parts:
            total = part if total is None else merged(total, part)
        if total is not None:
            yield pd.DataFrame({"n": [total[0]], "mean": [total[1]], "squares": [total[2]], "zeros": [total[3].astype(float)]})

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for b in batches:
            for r in b.itertuples(index=False):
                yield int(r.n), np.array(r.mean), np.array(r.squares), np.array(r.zeros)

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return fold(moments(model.transform(x)) for _, x in _chunks(batches))

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return fold(rows(batches))

    parts = series.select("series_id", "values").mapInPandas(first, schema).repartition(MERGERS).mapInPandas(again, schema).toPandas()
    total = None
    for part in rows([parts.sort_values("n")]):
        total = part if total is None else merged(total, part)
    return SparseScaler() if total is None else SparseScaler().fit_moments(total)  # no series, nothing to scale


def _hydra_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouped counts of the kernels, scaled by a scaler that is fitted on all series."""
    model, series = Hydra(64, seed=1), D.embedding_series(spark, sf_dir)
    scaler = _fitted(series, model)

    def run(batches):
        for ids, values in _chunks(batches):
            x = model.transform(values, by_group=True)
            yield pd.DataFrame({"series_id": ids, "features": list(scaler.transform(x.reshape(len(x), -1)))})
    return series.select("series_id", "values").mapInPandas(run, "series_id long, features array<double>")


_add("hydra", _hydra)
_add("hydra_scaled", _hydra_scaled)
_add("forest_pf2", _forest("pf2"))
_add("forest_pf2018", _forest("pf2018"))
_add("forest_pf2h", _forest("pf2h"))
_add("forest_try_all", _forest("pf2", try_all=True))
_add("forest_smooth", _forest("pf2", smooth=True))
__all__ = ["ORACLES", "QUERIES", "SparseScaler"]
