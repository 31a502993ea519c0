"""Dataset operators: series tables, labels, splits, class statistics, sampling, profiling.

A series table is series(series_id long, label string, values array<double>); all randomness is an md5 order of
(seed, id), so results do not depend on partitions or retries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C


def embedding_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("series_id"), F.col("label").cast("string").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("values"))


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series of values for each user, in (ts, event_id) order; lengths differ."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", F.col("value").cast("double").alias("value"))
    ordered = F.sort_array(F.collect_list(F.struct("ts", "event_id", "value")))
    return e.groupBy(F.col("user_id").alias("series_id")).agg(F.transform(ordered, lambda s: s["value"]).alias("values"))


def pseudo_random(key: Column, seed: int | str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def points(series: DataFrame, values: str = "values", *keep: str) -> DataFrame:
    return series.select("series_id", *keep, F.posexplode(values).alias("pos", "value"))


def with_transform(series: DataFrame, name: str, fn, source: str = "values") -> DataFrame:
    """One more column of transformed series; its name is the caller's."""
    return series.withColumn(name, fn(F.col(source)))


def series_stats(series: DataFrame, values: str = "values") -> DataFrame:
    """min, max, mean, median, sample standard deviation and the missing flag of each series."""
    v = F.col(values)
    ranked, n = F.sort_array(v), F.size(v)
    median = C.let(ranked, lambda s: (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2.0)
    return series.select("series_id", n.alias("length"), F.array_min(v).alias("min"), F.array_max(v).alias("max"), C.mean(v).alias("mean"), median.alias("median"),
                         C.stddev(v).alias("stddev"), C.has_missing(v).alias("has_missing"))


def split_stats(series: DataFrame, values: str = "values", *by: str) -> DataFrame:
    """min, max, mean, sample and population deviation over all points."""
    p = series.select(*by, F.explode(values).alias("x"))
    return p.groupBy(*by).agg(F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("stddev"), F.stddev_pop("x").alias("stddev_pop"))


def describe(series: DataFrame, values: str = "values") -> DataFrame:
    """Header: size, lengths, classes, missing data."""
    return series.agg(F.count(F.lit(1)).alias("size"), F.min(F.size(values)).alias("min_length"), F.max(F.size(values)).alias("max_length"),
                      F.count_distinct("label").alias("n_classes"), F.sum(C.has_missing(F.col(values)).cast("long")).alias("n_missing"),
                      F.sum(F.col("label").isNull().cast("long")).alias("n_unlabelled")).withColumn("variable_length", F.col("min_length") != F.col("max_length"))


def header_json(series: DataFrame, name: str) -> DataFrame:
    labels = series.where("label IS NOT NULL").agg(F.sort_array(F.collect_set("label")).alias("index_to_label"))
    one = describe(series).join(F.broadcast(labels), F.lit(True))  # one row each
    return one.select(F.to_json(F.struct(F.lit(name).alias("name"), "size", F.lit(1).alias("dimension"), F.array("min_length", "max_length").alias("length"),
                                         (F.col("n_missing") > 0).alias("has_missing_value"), "index_to_label")).alias("header"))


def encode_labels(series: DataFrame, known: list[str] | None = None) -> DataFrame:
    """(label, code): sorted distinct labels from 0; labels that extend a known encoder come after it, sorted too."""
    known = known or []
    place = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in known]).cast("array<string>"), F.col("label")), F.lit(0))
    labels = series.where("label IS NOT NULL").select("label").distinct().withColumn("at", F.when(place > 0, place).otherwise(len(known) + 1))
    new = labels.where(F.col("at") > len(known)).select("label", (F.row_number().over(Window.orderBy("label")) - 1 + len(known)).alias("code"))
    old = labels.where(F.col("at") <= len(known)).select("label", (F.col("at") - 1).cast("int").alias("code"))
    return new.unionByName(old)


def first_seen_labels(series: DataFrame, order: str) -> DataFrame:
    """(label, code) by first appearance."""
    first = series.groupBy("label").agg(F.min(order).alias("first"))
    return first.select("label", (F.row_number().over(Window.orderBy("first", "label")) - 1).alias("code"))


def class_counts(series: DataFrame, header: DataFrame) -> DataFrame:
    """Cardinality of every class of the header, zero where it has none."""
    n = series.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return header.select("label").distinct().join(n, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def class_probabilities(series: DataFrame) -> DataFrame:
    """(label, n, p): share of each class; only the counts, one row a class, meet."""
    n = series.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return n.join(F.broadcast(n.agg(F.sum("n").alias("all"))), F.lit(True)).select("label", "n", (F.col("n") / F.col("all")).alias("p"))  # one row


#: Ranges of ids that numbered() makes at most.
RANGES = 256


def numbered(series: DataFrame) -> DataFrame:
    """series_id 0.. in id order: ranks within ranges of ids plus the rows of the ranges before.

    The bounds of the ranges are read once.  Range partitions would not do: counts and ranks are two branches of the plan, each
    samples its own bounds on tables that it does not sample whole, and rows would get another's number or none.
    """
    blocks = min(int(series.sparkSession.conf.get("spark.sql.shuffle.partitions")), RANGES)
    shares = [k / blocks for k in range(1, blocks)] or [0.5]
    bounds = sorted(set(series.agg(F.percentile_approx("series_id", shares)).first()[0] or []))  # one row

    def place(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("series_id") > bounds[mid], place(mid + 1, hi)).otherwise(place(lo, mid))

    part = series.withColumn("part", place(0, len(bounds)))
    counts = part.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # one row a range
    before = counts.select(F.col("part").alias("of"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    ranked = part.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy("series_id")))
    return ranked.join(F.broadcast(before), F.col("part") == F.col("of")).select((F.col("before") + F.col("rank") - 1).cast("long").alias("series_id"), *[c for c in series.columns if c != "series_id"])


def by_class(series: DataFrame) -> DataFrame:
    """label -> sorted ids; unlabelled ids are the row with a null label."""
    return series.groupBy("label").agg(F.sort_array(F.collect_list("series_id")).alias("ids"))


def gini(series: DataFrame, *by: str) -> DataFrame:
    """1 - sum p^2 of the labels (0 for up to one item), for each group."""
    n = series.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("n"))
    g = n.groupBy(*by).agg(F.sum("n").alias("size"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    return g.select(*by, "size", F.when(F.col("size") <= 1, 0.0).otherwise(1 - F.col("squares") / (F.col("size") * F.col("size"))).alias("gini"))


def weighted_gini(series: DataFrame, branch: str) -> DataFrame:
    return gini(series, branch).agg((F.sum(F.col("size") * F.col("gini")) / F.sum("size")).alias("weighted_gini"))


def pick_one_by_class(series: DataFrame, seed: int = 0) -> DataFrame:
    """One pseudo-random id for each class; min_by needs no sort and combines on the map side."""
    return series.where("label IS NOT NULL").groupBy("label").agg(F.min(F.struct(pseudo_random(F.col("series_id"), seed).alias("r"), "series_id")).alias("pick")).select("label", "pick.series_id")


def stratified_sample(series: DataFrame, ratio: float, seed: int = 0) -> DataFrame:
    """ceil(ratio * n) of every class, at least one; above 1 whole copies and a remainder."""
    whole, part = int(ratio), ratio - int(ratio)
    n = series.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("label").orderBy(pseudo_random(F.col("series_id"), seed), "series_id")
    ranked = series.select("series_id", "label", F.row_number().over(w).alias("rank")).join(n, "label")
    most = F.greatest(F.ceil(F.lit(part) * F.col("n")), F.lit(0 if whole or part else 1))
    times = F.lit(whole) + F.when(F.col("rank") <= most, 1).otherwise(0)
    return ranked.select("series_id", "label", F.explode(F.array_repeat(F.lit(1), times.cast("int"))).alias("one")).select("series_id", "label")


def stratified_subset(series: DataFrame, share: float, least: int, seed: int = 0) -> DataFrame:
    """max(floor(share * n), least) items, round robin over the classes of shuffled ids."""
    most = max(int(share * series.count()), least)
    w = Window.partitionBy("label").orderBy(pseudo_random(F.col("series_id"), seed))
    return series.withColumn("rank", F.row_number().over(w)).orderBy("rank", "label").limit(most).drop("rank")


def shuffled(series: DataFrame, seed: int) -> DataFrame:
    return series.orderBy(pseudo_random(F.col("series_id"), seed))


def bag(series: DataFrame, size: int, seed: int) -> DataFrame:
    """A sample without replacement."""
    return shuffled(series, seed).limit(size)


def subset(series: DataFrame, ids: DataFrame) -> DataFrame:
    return series.join(ids.select("series_id"), "series_id", "left_semi")


def complement(series: DataFrame, ids: DataFrame) -> DataFrame:
    return series.join(ids.select("series_id"), "series_id", "left_anti")


def duplicates(series: DataFrame) -> DataFrame:
    """Groups of equal series: the ids of each, sorted."""
    return series.groupBy("values").agg(F.sort_array(F.collect_list("series_id")).alias("ids")).where(F.size("ids") > 1).select("ids")


def sanity_check(train: DataFrame, test: DataFrame) -> list[str]:
    """Messages on unlabelled train series, variable lengths and missing data."""
    out = []
    for name, split in (("train", train), ("test", test)):
        d = describe(split).first()
        if name == "train" and d["n_unlabelled"]:
            out.append(f"{name}: {d['n_unlabelled']} series without label")
        if d["variable_length"]:
            out.append(f"{name}: variable length")
        if d["n_missing"]:
            out.append(f"{name}: missing data")
    return out
