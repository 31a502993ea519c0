"""Readers and writers of series files.  Lines are read by Spark; only the header lines of a file go to the driver."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_FLAGS = ("timestamps", "missing", "univariate", "equallength")
_KNOWN = {*_FLAGS, "problemname", "serieslength", "classlabel", "targetlabel", "data", "dimensions", "dimension"}


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(at, line): `at` rises in file order."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), F.trim("value").alias("line"))


def _numbered(df: DataFrame) -> DataFrame:
    """series_id 0.. in file order: a rank within each read partition (the high bits of `at`) plus the rows before it."""
    part = df.withColumn("part", F.shiftright("at", 33))
    counts = part.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # one row for each partition that was read
    before = counts.select(F.col("part").alias("of"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    ranked = part.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy("at")))
    joined = ranked.join(before, F.col("part") == F.col("of"))
    return joined.select((F.col("before") + F.col("rank") - 1).cast("long").alias("series_id"), *[c for c in df.columns if c != "at"])


def _number(x: Column) -> Column:
    """NaN for empty, `?` and unreadable fields; inf and infinity are numbers."""
    return F.coalesce(F.trim(x).try_cast("double"), F.lit(float("nan")))


def parse_ts_header(lines: list[str]) -> dict:
    h: dict = {"problemname": "Anonymous", "timestamps": False, "missing": False, "univariate": True, "equallength": None, "serieslength": None, "labels": None, "data": False}
    for line in lines:
        name, *rest = line[1:].split()
        name = name.lower()
        if name not in _KNOWN:
            raise ValueError(f"unknown directive @{name}")
        if name in _FLAGS:
            h[name] = rest[0].lower() == "true"
        elif name == "problemname":
            h[name] = rest[0]
        elif name == "serieslength":
            h[name] = int(rest[0])
            if h[name] <= 0:
                raise ValueError("@serieslength must be positive")
        elif name in ("classlabel", "targetlabel"):
            if rest[0].lower() == "true":
                if len(rest) < 2 and name == "classlabel":
                    raise ValueError("@classlabel true without labels")
                h["labels"] = rest[1:]
        elif name == "data":
            h["data"] = True
    if not h["data"]:
        raise ValueError("no @data")
    if h["equallength"] is False and h["serieslength"]:
        raise ValueError("@serieslength with @equallength false")
    return h


def read_ts(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(series_id, label, values) for one dimension, values array<array<double>> for more, and the header."""
    rows = _lines(spark, path).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    header = parse_ts_header([r["line"] for r in rows.where(F.col("line").startswith("@")).orderBy("at").collect()])
    data = rows.where(~F.col("line").startswith("@"))
    parts = F.split("line", ":")
    dims = F.slice(parts, F.lit(1), F.size(parts) - 1) if header["labels"] is not None else parts
    values = F.transform(dims, lambda d: F.transform(F.split(d, ","), _number))
    out = data.select("at", (F.trim(F.element_at(parts, -1)) if header["labels"] is not None else F.lit(None).cast("string")).alias("label"), values.alias("dims"),
                      F.exists(dims, lambda d: F.exists(F.split(d, ","), lambda x: (F.trim(x) != "?") & F.trim(x).try_cast("double").isNull())).alias("bad"))
    seen = out.agg(F.min(F.size("dims")).alias("least"), F.max(F.size("dims")).alias("most"), F.min(F.size(F.get("dims", F.lit(0)))).alias("short"),
                   F.max(F.size(F.get("dims", F.lit(0)))).alias("long"), F.max(F.col("bad").cast("int")).alias("bad"), F.sum((~F.coalesce(F.col("label").isin(header["labels"] or []), F.lit(True))).cast("int")).alias("odd")).first()
    if seen["bad"]:
        raise ValueError("a value is not a number")
    if seen["least"] is not None:
        if seen["least"] != seen["most"] or seen["least"] < 1 or (header["univariate"] and seen["most"] != 1):
            raise ValueError("wrong number of dimensions")
        if header["equallength"] and (seen["short"] != seen["long"] or (header["serieslength"] or seen["long"]) != seen["long"]):
            raise ValueError("unequal lengths")
        if header["labels"] and seen["odd"]:
            raise ValueError("missing or undeclared label")
    header |= {"dimensions": seen["most"] or 0}
    value = F.get("dims", F.lit(0)) if seen["most"] == 1 else F.col("dims")
    return _numbered(out.select("at", "label", value.alias("values"))).select("series_id", "label", "values"), header


def read_csv(spark: SparkSession, path: str, label: str = "first", header: bool = False, sep: str = ",", comments: str = "%@") -> DataFrame:
    """(series_id, label, values); label: first, last or none.  Rows may be ragged; unreadable fields are NaN."""
    rows = _lines(spark, path).where(F.col("line") != "")
    for c in comments:
        rows = rows.where(~F.col("line").startswith(c))
    if header:
        first = rows.agg(F.min("at").alias("first"))
        rows = rows.join(F.broadcast(first), F.col("at") > F.col("first")).select("at", "line")  # one row
    f = F.split("line", "[" + sep + "]" if sep != "\t" else "\t")
    value = {"first": F.slice(f, F.lit(2), F.greatest(F.size(f) - 1, F.lit(0))), "last": F.slice(f, F.lit(1), F.greatest(F.size(f) - 1, F.lit(0))), "none": f}[label]
    name = {"first": F.trim(F.get(f, F.lit(0))), "last": F.trim(F.element_at(f, -1)), "none": F.lit(None).cast("string")}[label]
    return _numbered(rows.select("at", name.alias("label"), F.transform(value, _number).alias("values"))).select("series_id", "label", "values")


def read_delimited(spark: SparkSession, path: str, sep: str = "\t", label: str = "first") -> DataFrame:
    """Integer labels; a missing tail and missing points are filled by interpolation."""
    from ..functions.columns import interpolate
    df = read_csv(spark, path, label, sep=sep, comments="")
    width = df.agg(F.max(F.size("values")).alias("w")).first()["w"] or 0
    padded = F.concat("values", F.array_repeat(F.lit(float("nan")), F.lit(width) - F.size("values")))
    return df.select("series_id", F.col("label").cast("double").cast("int").cast("string").alias("label"), interpolate(padded).alias("values"))


def train_test_paths(root: str, name: str, ext: str = "ts") -> tuple[str, str]:
    return f"{root}/{name}/{name}_TRAIN.{ext}", f"{root}/{name}/{name}_TEST.{ext}"


def resample_paths(root: str, name: str, fold: int) -> tuple[str, str]:
    return tuple(f"{root}/UCR_Resamples/resample{part}{fold}/{name}_{part.upper()}.txt" for part in ("train", "test"))


def load_dataset(spark: SparkSession, root: str, name: str, ext: str = "ts") -> tuple[DataFrame, DataFrame]:
    train, test = train_test_paths(root, name, ext)
    if ext == "ts":
        return read_ts(spark, train)[0], read_ts(spark, test)[0]
    if ext == "tsv":
        return read_delimited(spark, train), read_delimited(spark, test)
    return read_csv(spark, train), read_csv(spark, test)


def resample(train: DataFrame, test: DataFrame, indices: DataFrame) -> DataFrame:
    """Rows of train and test by position: index >= size of train is a position in test.  indices(position)."""
    n = train.count()
    both = train.unionByName(test.withColumn("series_id", F.col("series_id") + n))
    return both.join(indices.select(F.col("position").alias("series_id")), "series_id", "left_semi")


def read_flat(spark: SparkSession, root: str, name: str, fold: int) -> tuple[DataFrame, DataFrame]:
    """X, y, metadata and test-index files: flattened channel-major series, split into train and test of a fold."""
    meta = [int(x) for x in spark.read.text(f"{root}/{name}_metadata.csv").where("value RLIKE '[0-9]'").first()["value"].split(",")]
    _, dims, length = meta
    x = _numbered(_lines(spark, f"{root}/{name}_X.csv").where("line <> ''").select("at", F.transform(F.split("line", ","), _number).alias("flat")))
    y = _numbered(_lines(spark, f"{root}/{name}_y.csv").where("line <> ''").select("at", F.col("line").alias("label")))
    value = F.col("flat") if dims == 1 else F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.slice("flat", d * length + 1, F.lit(length)))
    series = x.join(y, "series_id").select("series_id", "label", value.alias("values"))
    held = spark.read.text(f"{root}/test_indices_fold_{fold}.txt").select(F.trim("value").try_cast("long").alias("series_id")).where("series_id IS NOT NULL")
    return series.join(held, "series_id", "left_anti"), series.join(held, "series_id", "left_semi")


def write_ts(series: DataFrame, path: str, name: str, comment: str = "") -> None:
    """One .ts text file (a directory as Spark writes it); an empty table raises."""
    stats = series.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("values")).alias("lo"), F.max(F.size("values")).alias("hi"), F.sort_array(F.collect_set("label")).alias("labels"),
                       F.max(F.exists("values", lambda x: F.isnan(x)).cast("int")).alias("missing")).first()
    if not stats["n"]:
        raise ValueError("nothing to write")
    flag = lambda b: str(bool(b)).lower()
    head = [f"# {x}" for x in comment.splitlines()] + [f"@problemName {name}", "@timestamps false", f"@missing {flag(stats['missing'])}", "@univariate true", f"@equalLength {flag(stats['lo'] == stats['hi'])}"]
    head += [f"@seriesLength {stats['hi']}"] * (stats["lo"] == stats["hi"]) + [f"@classLabel {flag(stats['labels'])} {' '.join(stats['labels'])}".rstrip(), "@data"]
    text = F.concat_ws(",", F.transform("values", lambda x: F.when(F.isnan(x), "?").otherwise(x.cast("string"))))
    rows = series.select(F.col("series_id").alias("at"), F.concat_ws(":", text, "label").alias("value"))
    spark = series.sparkSession
    top = spark.createDataFrame([(i - len(head), x) for i, x in enumerate(head)], "at long, value string")
    top.unionByName(rows).coalesce(1).sortWithinPartitions("at").select("value").write.mode("overwrite").text(path)


def write_probabilities(predictions: DataFrame, codes: DataFrame, path: str) -> None:
    """CSV with one column for each class."""
    labels = [r["label"] for r in codes.orderBy("code").collect()]  # one row for each class
    predictions.select("series_id", *[F.get("probabilities", F.lit(i)).alias(str(x)) for i, x in enumerate(labels)]).write.mode("overwrite").csv(path, header=True)


def result_json(train: dict, test: dict, seconds: dict, n_correct: int, n: int, classifier: dict) -> str:
    return json.dumps({"dataset": {"train": train, "test": test}, "seconds": seconds, "nb_corrects": n_correct, "accuracy": n_correct / n if n else None, "classifier": classifier})


def write_key_values(spark: SparkSession, facts: dict, predictions: DataFrame, path: str) -> None:
    """key,value lines, then a predictions block."""
    head = [f"{k},{v}" for k, v in facts.items()] + ["predictions"]
    top = spark.createDataFrame([(i - len(head), x) for i, x in enumerate(head)], "at long, value string")
    rows = predictions.select(F.col("series_id").alias("at"), F.concat_ws(",", F.col("predicted").cast("string"), F.concat_ws(",", F.transform("probabilities", lambda p: p.cast("string")))).alias("value"))
    top.unionByName(rows).coalesce(1).sortWithinPartitions("at").select("value").write.mode("overwrite").text(path)
