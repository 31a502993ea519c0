"""Shared pieces of the corpus operators: words, shingles, scratch tables, checked broadcasts.

Word rule everywhere: a word is a maximal run of ``[^\\x20\\x09-\\x0D]``; a null text has none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import drop, keep, tracked  # noqa: F401

SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A table is sent to every executor only after its rows were counted, and measured as JSON, and are no more than this.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it many times inside `body`, also within nested lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text_or_empty(text), SPACE), "")


def ascii_lower(text: Column) -> Column:
    """Only A-Z change; lower() would also change other letters."""
    return F.translate(text, UPPER, LOWER)


def shingles(w: Column, n: int, make: Callable[..., Column]) -> Column:
    """make(word, ..., word) of every n-word window of the array w; none below n words."""
    def window(a: Column) -> Column:
        heads = F.slice(a, F.lit(1), F.greatest(F.size(a) - F.lit(n - 1), F.lit(0)))
        return F.transform(heads, lambda x, i: make(x, *[F.get(a, i + k) for k in range(1, n)]))

    return let(w, window)


def sized(kept: DataFrame) -> DataFrame:
    """Mark a kept (written) table for broadcast if its rows stay within BROADCAST_ROWS and BROADCAST_BYTES."""
    if kept.count() > BROADCAST_ROWS:
        return kept
    size = kept.agg(F.sum(F.length(F.to_json(F.struct("*")))).alias("size")).first()["size"]
    return F.broadcast(kept) if (size or 0) <= BROADCAST_BYTES else kept


#: Bits of a possible() filter; whole tables of them are broadcast, 32 MB whatever the number of keys.
FILTER_BITS, PAGE_BITS = 1 << 27, 1 << 15


def possible(spark: SparkSession, keys: DataFrame, key: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """(pages, filter): filter(df, column) keeps every row whose column is among the keys, and few others, without a shuffle of df.

    Each key (long) sets one of FILTER_BITS bits; pages of bits are rows of a table that never has more than FILTER_BITS / PAGE_BITS
    rows, so it may be broadcast.  Beyond some 10^8 keys the filter lets most rows pass and a join behind it does the work.
    """
    def place(c: Column) -> Column:
        return F.xxhash64(c).bitwiseAND(FILTER_BITS - 1)

    spots = keys.select(place(F.col(key)).alias("at")).select(F.shiftright("at", 15).alias("page"), F.col("at").bitwiseAND(PAGE_BITS - 1).alias("bit")).distinct()
    held = spots.groupBy("page").agg(F.collect_list("bit").alias("bits"))  # up to PAGE_BITS numbers a page

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.packbits(np.bincount(bits.values.to_numpy(), minlength=PAGE_BITS).astype(np.uint8), bitorder="little").view(np.int64) for bits in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.list_(pa.int64()))], names=["page", "words"])

    pages = keep(spark, held.mapInArrow(pack, "page long, words array<long>"), "filter-pages")

    def passed(df: DataFrame, column: str, mark: bool = False) -> DataFrame:
        """The rows that pass; with mark all rows and passed__."""
        held = F.broadcast(pages.select(F.col("page").alias("page__"), F.col("words").alias("words__")))
        at = df.withColumn("at__", place(F.col(column))).join(held, F.shiftright("at__", 15) == F.col("page__"), "left" if mark else "inner")
        word = F.get("words__", F.shiftright(F.col("at__").bitwiseAND(PAGE_BITS - 1), 6).cast("int"))
        bit = F.getbit(word, F.col("at__").bitwiseAND(63).cast("int")) == 1
        return at.select(*df.columns, F.coalesce(bit, F.lit(False)).alias("passed__")) if mark else at.where(bit).select(*df.columns)

    return pages, passed
