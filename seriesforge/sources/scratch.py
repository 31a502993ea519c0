"""Tables and folders in the shared scratch folder, removed as soon as they are dropped and at the latest when the JVM ends."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Spark removes the shuffle files of a query once it has ended, not when the driver happens to collect its plan.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_tracked: ContextVar[list[DataFrame] | None] = ContextVar("tracked", default=None)


def root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a folder in the warehouse where none is named (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch").rstrip("/")


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in this application's scratch folder, which Hadoop deletes when the JVM ends, also after spark.stop()."""
    own = f"{root(spark)}/{spark.sparkContext.applicationId}"
    target, fs = _file_system(spark, own)
    fs.mkdirs(target)
    fs.deleteOnExit(target)
    return f"{own}/{name}-{uuid.uuid4().hex}"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_FREE_SHUFFLES, None)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREE_SHUFFLES)
        else:
            spark.conf.set(_FREE_SHUFFLES, before)


def keep(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: cuts lineage, survives lost executors."""
    path = new_folder(spark, label)
    with freed_shuffles(spark):
        df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.scratch_path = path
    if (made := _tracked.get()) is not None:
        made.append(kept)
    return kept


def drop(*kept: DataFrame) -> None:
    """Delete tables that keep() returned; nothing may read them any more."""
    for df in kept:
        target, fs = _file_system(df.sparkSession, df.scratch_path)
        fs.delete(target, True)
        if (made := _tracked.get()) is not None:
            made[:] = [t for t in made if t is not df]


@contextmanager
def tracked() -> Iterator[list[DataFrame]]:
    """A list of the tables that keep() makes inside the block and that are not dropped there."""
    made: list[DataFrame] = []
    token = _tracked.set(made)
    try:
        yield made
    finally:
        _tracked.reset(token)
