"""Train and test a proximity forest on series files: python -m seriesforge --ucr FOLDER NAME -t 100 -c 5 -o result.json"""

from __future__ import annotations

import argparse
import json
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import dataset as D
from .operators import forest
from .sources import files


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser("seriesforge", description="proximity forest of time series")
    source = p.add_mutually_exclusive_group(required=True)
    source.add_argument("--ucr", nargs=2, metavar=("FOLDER", "NAME"), help="FOLDER/NAME/NAME_TRAIN.ts and NAME_TEST.ts")
    source.add_argument("--csv", nargs=3, metavar=("TRAIN", "TEST", "NAME"), help="CSV files, label first")
    p.add_argument("--csv-skip-header", action="store_true")
    p.add_argument("--csv-separator", default=",")
    p.add_argument("--pfc", default="pf2018", help="pf2018, pf2 or names of distances joined by ':'")
    p.add_argument("-t", "--nb-trees", type=int, default=100)
    p.add_argument("-c", "--nb-candidates", type=int, default=5)
    p.add_argument("-p", "--nb-threads", type=int, default=0, help="threads of a local session; up to 0: all")
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("-o", "--out", help="JSON result")
    p.add_argument("--probout", help="folder of a CSV with one probability column for each class")
    return p.parse_args(argv)


def load(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame, str]:
    if a.ucr:
        return *files.load_dataset(spark, *a.ucr), a.ucr[1]
    return *[files.read_csv(spark, path, header=a.csv_skip_header, sep=a.csv_separator) for path in a.csv[:2]], a.csv[2]


def run(spark: SparkSession, a: argparse.Namespace) -> dict:
    """The result, written where --out and --probout say; tables that fail the sanity check raise."""
    began = time.time()
    train, test, name = load(spark, a)
    train, test = train.persist(), test.persist()
    wrong = D.sanity_check(train, test)
    if wrong:
        raise ValueError("; ".join(wrong))
    codes = D.encode_labels(train)
    heads = [json.loads(D.header_json(x, name).first()["header"]) for x in (train, test)]
    loaded = time.time()
    model = forest.fit(train, codes, a.nb_trees, a.nb_candidates, a.pfc, a.seed).persist()
    model.count()
    trained = time.time()
    found = forest.predict(model, test).persist()
    correct = found.join(test.select("series_id", "label"), "series_id").join(codes, "label").agg(F.sum((F.col("predicted") == F.col("code")).cast("long")).alias("n")).first()["n"] or 0
    seconds = {"load": loaded - began, "train": trained - loaded, "test": time.time() - trained}
    result = files.result_json(*heads, seconds, correct, heads[1]["size"], {"name": "forest", "splitters": a.pfc, "trees": a.nb_trees, "candidates": a.nb_candidates, "seed": a.seed})
    if a.out:
        Path(a.out).write_text(result)
    if a.probout:
        files.write_probabilities(found, codes, a.probout)
    return json.loads(result)


def main(argv: list[str]) -> None:
    a = arguments(argv)
    builder = SparkSession.builder.appName("seriesforge")
    if a.nb_threads > 0:
        builder = builder.master(f"local[{a.nb_threads}]")
    spark = builder.getOrCreate()
    try:
        print(json.dumps(run(spark, a)))
    finally:
        spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
