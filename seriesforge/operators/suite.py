"""The 1-NN suite: a classifier by name, leave-one-out search of its parameters on train, test scored with the first best.

Searches run through neighbours.nearest, so neither table is collected; what reaches the driver is one row a search (the
best parameter set) and one row for each statistic that a grid needs.

Defined results: an unknown name raises; of equally good parameter sets the first of the grid is taken; unlabelled series
count as errors only if their nearest is labelled; without train rows there is no prediction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans import grids
from . import dataset as D
from . import neighbours as N

#: Pairs of series that the mean direct cost is taken from.
PAIRS = 4000


def transformed(series: DataFrame, transform: str) -> DataFrame:
    """Values under `default` or `derivativeN`."""
    degree = int(transform.removeprefix("derivative")) if transform != "default" else 0
    return series.withColumn("values", C.derivative(F.col("values"), degree)) if degree else series


def direct_cost(series: DataFrame, exponents: list[float], pairs: int = PAIRS, seed: int = 0) -> DataFrame:
    """(cfe, mean_cost): mean direct distance over `pairs` pairs of two different series drawn by md5 of (seed, number of the
    pair), for each exponent; pairs of unequal lengths do not count, a single series is paired with itself."""
    spark, n = series.sparkSession, series.count()

    def drawn(side: str, of: int):
        digest = D.pseudo_random(F.concat(F.lit(f"{side}:"), F.col("id").cast("string")), seed)
        return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % F.lit(max(of, 1))

    places = spark.range(pairs).select("id", drawn("x", n).alias("x")).select("x", ((F.col("x") + 1 + drawn("y", n - 1)) % F.lit(max(n, 1))).alias("y"))
    rows = D.numbered(series).select("series_id", "values")
    both = places.join(rows.select(F.col("series_id").alias("x"), F.col("values").alias("a")), "x").join(rows.select(F.col("series_id").alias("y"), F.col("values").alias("b")), "y")
    cost = both.where(F.size("a") == F.size("b")).select(F.explode(F.array(*[F.struct(F.lit(float(e)).alias("cfe"), C.directa(F.col("a"), F.col("b"), e).alias("cost")) for e in exponents])).alias("c"))
    return cost.groupBy("c.cfe").agg(F.avg("c.cost").alias("mean_cost"))


def grid_of(train: DataFrame, named: dict, pairs: int = PAIRS, seed: int = 0) -> list[dict]:
    """Parameter sets of a classifier that grids.by_name has read, in the order in which they are tried."""
    family, cfe = named["family"], named["params"].get("cfe")
    if family == "ED":
        return [named["params"]]
    if family == "Minkowski":
        return [{"cfe": cfe}] if cfe else grids.minkowski_grid()
    if family in ("ADTW", "ADTW+"):
        exponents = [cfe] if cfe else grids.AMERCED_EXPONENTS if family == "ADTW+" else [2.0]
        found = {r["cfe"]: r["mean_cost"] for r in direct_cost(train, exponents, pairs, seed).collect()}  # one row an exponent
        return grids.adtw_grid({float(e): found[float(e)] for e in exponents})
    length = train.agg(F.max(F.size("values"))).first()[0] or 0
    if family == "LCSS":
        return grids.lcss_grid(length, D.split_stats(train).first()["stddev"])
    return grids.cdtw_grid(length, exponents=[cfe] if cfe else grids.PLUS_EXPONENTS if family == "CDTW+" else [2.0])


def search(train: DataFrame, test: DataFrame, name: str, grid: list[dict] | None = None, sample: DataFrame | None = None) -> tuple[int, dict, DataFrame]:
    """(place in the grid, parameters, predictions of test) of the named classifier.

    predictions: (series_id, label, predicted, correct), the class that most nearest series have, the least on ties.
    grid: other parameter sets than the classifier's own; sample(series_id): score only these in the search.
    """
    named = grids.by_name(name)
    train, test = transformed(train, named["transform"]), transformed(test, named["transform"])
    grid = grid or grid_of(train, named)
    best = 0
    if len(grid) > 1:
        first = N.loocv(train, named["distance"], grid, sample).where("best").agg(F.min("param")).first()[0]
        best = first or 0
    return best, grid[best], N.vote_of_ties(N.nearest_counts(test, train, named["distance"], grid[best]))
