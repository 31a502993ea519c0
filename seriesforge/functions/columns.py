"""Series functions as native Spark columns over array<double> (no Python workers)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once for many uses inside `body`."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def point_cost(exponent: float) -> Callable[[Column, Column], Column]:
    """|x - y| ** exponent; 1, 2 and 0.5 without pow."""
    if exponent == 1:
        return lambda x, y: F.abs(x - y)
    if exponent == 2:
        return lambda x, y: (x - y) * (x - y)
    if exponent == 0.5:
        return lambda x, y: F.sqrt(F.abs(x - y))
    return lambda x, y: F.pow(F.abs(x - y), F.lit(float(exponent)))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def mean(v: Column) -> Column:
    return total(v) / F.size(v)


def stddev(v: Column, population: bool = False) -> Column:
    """Two passes; NaN for fewer than two points of a sample."""
    n = F.size(v)
    squares = let(mean(v), lambda m: total(F.transform(v, lambda x: (x - m) * (x - m))))
    return F.sqrt(squares / n) if population else F.when(n > 1, F.sqrt(squares / (n - 1))).otherwise(F.lit(float("nan")))


def derivative(v: Column, degree: int = 1) -> Column:
    """((x_i - x_{i-1}) + (x_{i+1} - x_{i-1}) / 2) / 2, ends copied from their neighbours; up to two points stay."""
    def once(a: Column) -> Column:
        def at(i: Column) -> Column:
            k = F.least(F.greatest(i, F.lit(1)), F.size(a) - 2)
            return ((F.get(a, k) - F.get(a, k - 1)) + (F.get(a, k + 1) - F.get(a, k - 1)) / 2.0) / 2.0
        return F.when(F.size(a) <= 2, a).otherwise(F.transform(a, lambda _x, i: at(i)))
    for _ in range(degree):
        v = let(v, once)
    return v


def difference(v: Column, order: int = 1) -> Column:
    for _ in range(order):
        v = let(v, lambda a: F.zip_with(F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), lambda x, y: x - y))
    return v


def minmax(v: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Constant series become (high - low) / 2."""
    lo, hi = F.array_min(v), F.array_max(v)
    return let(F.struct(lo.alias("lo"), hi.alias("hi")), lambda e: F.transform(v, lambda x: F.when(e["lo"] == e["hi"], F.lit((high - low) / 2.0)).otherwise(
        F.lit(low) + (x - e["lo"]) * F.lit(high - low) / (e["hi"] - e["lo"]))))


def percentile_minmax(v: Column, p: int = 10, low: float = 0.0, high: float = 1.0) -> Column:
    """minmax between two percentiles (integer positions of the sorted series, the upper one at most the last), not clipped."""
    def over(s: Column) -> Column:
        n = F.size(s)
        lo, hi = F.get(s, F.floor(n * p / 100).cast("int")), F.get(s, F.least(F.floor(n * (100 - p) / 100).cast("int"), n - 1))
        return let(F.struct(lo.alias("lo"), hi.alias("hi")), lambda e: F.transform(v, lambda x: F.when(e["lo"] == e["hi"], F.lit((high - low) / 2.0)).otherwise(
            F.lit(low) + (x - e["lo"]) * F.lit(high - low) / (e["hi"] - e["lo"]))))
    return let(F.sort_array(v), over)


def meannorm(v: Column) -> Column:
    lo, hi = F.array_min(v), F.array_max(v)
    return let(F.struct(mean(v).alias("m"), (hi - lo).alias("r")), lambda e: F.when(e["r"] == 0, v).otherwise(F.transform(v, lambda x: (x - e["m"]) / e["r"])))


def unitlength(v: Column) -> Column:
    return let(F.sqrt(total(F.transform(v, lambda x: x * x))), lambda n: F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n)))


def zscore(v: Column) -> Column:
    return let(F.struct(mean(v).alias("m"), stddev(v).alias("s")), lambda e: F.when((e["s"] == 0) | F.isnan(e["s"]), v).otherwise(F.transform(v, lambda x: (x - e["m"]) / e["s"])))


def rescale(v: Column, length: int) -> Column:
    """out[j] = x[floor(j * len / length)]."""
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda j: F.get(v, F.floor(j * F.size(v) / F.lit(length)).cast("int")))


def chop(v: Column, length: int) -> Column:
    return F.slice(v, F.lit(1), F.lit(length))


def pad_zero(v: Column) -> Column:
    return F.concat(F.array(F.lit(0.0)), v, F.array(F.lit(0.0)))


def has_missing(v: Column) -> Column:
    return F.exists(v, lambda x: F.isnan(x))


def interpolate(v: Column) -> Column:
    """Interior runs of NaN linearly in the index, leading ones from the next value, trailing ones from the last; all NaN stays.

    Every known point fills the stretch up to the next one, so the work grows with the length.
    """
    def over(known: Column) -> Column:
        def stretch(e: Column, k: Column) -> Column:
            after = F.get(known, k + 1)
            between = F.transform(F.sequence(F.lit(0), after["i"] - e["i"] - 1), lambda j: F.when(j == 0, e["v"]).otherwise(e["v"] + (after["v"] - e["v"]) * j / (after["i"] - e["i"])))
            return F.when(after.isNull(), F.array_repeat(e["v"], F.size(v) - e["i"])).otherwise(between)
        first = F.get(known, F.lit(0))
        return F.when(F.size(known) == 0, v).otherwise(F.concat(F.array_repeat(first["v"], first["i"]), F.flatten(F.transform(known, stretch))))
    indexed = F.filter(F.transform(v, lambda x, i: F.struct(i.alias("i"), x.alias("v"))), lambda e: ~F.isnan(e["v"]))
    return F.when(has_missing(v), let(indexed, over)).otherwise(v)


def directa(a: Column, b: Column, exponent: float = 2.0) -> Column:
    """Point by point, no root; null (infinitely far) for unequal lengths."""
    return F.when(F.size(a) == F.size(b), total(F.zip_with(a, b, point_cost(exponent))))


def minkowski(a: Column, b: Column, p: float = 2.0) -> Column:
    return F.pow(directa(a, b, p), F.lit(1.0 / p))


def manhattan(a: Column, b: Column) -> Column:
    return directa(a, b, 1.0)


def lorentzian(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.log1p(F.abs(x - y))))


def envelope(v: Column, w: int, upper: bool = True) -> Column:
    pick = F.array_max if upper else F.array_min
    return F.transform(v, lambda _x, i: pick(F.slice(v, F.greatest(i - w, F.lit(0)) + 1, F.least(i + w, F.size(v) - 1) - F.greatest(i - w, F.lit(0)) + 1)))


def lb_keogh(a: Column, b: Column, w: int, exponent: float = 2.0) -> Column:
    c = point_cost(exponent)
    env = F.zip_with(envelope(b, w), envelope(b, w, False), lambda u, l: F.struct(u.alias("u"), l.alias("l")))
    return total(F.zip_with(a, env, lambda q, e: F.when(q > e["u"], c(q, e["u"])).when(q < e["l"], c(q, e["l"])).otherwise(0.0)))


def lb_keogh2j(a: Column, b: Column, w: int, exponent: float = 2.0) -> Column:
    return F.greatest(lb_keogh(a, b, w, exponent), lb_keogh(b, a, w, exponent))


def wdtw_weights(g: float, length: int, wmax: float = 1.0) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.lit(wmax) / (F.lit(1.0) + F.exp(F.lit(-g) * (i - F.lit(length / 2.0)))))


def most_probable(p: Column) -> Column:
    """Positions (0-based) of the largest probability."""
    return let(F.array_max(p), lambda m: F.filter(F.transform(p, lambda x, i: F.when(x == m, i)), lambda i: i.isNotNull()))


def smooth_probabilities(n: Column, k: int, top: int) -> Column:
    """(1 + n at the leaf's class) / (classes + n)."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (F.lit(1.0) + F.when(i == top, n).otherwise(0)) / (n + k))
