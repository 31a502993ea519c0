"""Benchmark decontamination (native): size-partitioned MinHash containment search, verified exactly.

An item counts as leaked into a document if at least `threshold` of its distinct five-word shingles are in it.
Short items inside long documents have a tiny Jaccard similarity, so bands of a symmetric MinHash would miss them.
Here the items are partitioned by shingle count (powers of two); an item of n shingles keeps as its sketch the
floor((1-t) n) + 1 least shingle hashes (a bottom-k MinHash).  A document that contains t n of the shingles misses at
most floor((1-t) n), so at least one sketch hash is among the document's hashes: the search loses nothing.  Each size
partition has its own largest sketch hash; documents send only hashes up to the largest of the partitions whose items
can fit (t n <= size of the document).  Candidates are then verified by exact shingle containment on the words.

Defined results: words are lower-cased (A-Z); items of under five words have no shingle and are skipped; null or short
documents match nothing; rows that share a doc_id are one document; repeated items each get their rows; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, drop, keep, shingles, sized, table, text_or_empty, tracked, words

N = 5
THRESHOLD = 0.8


def _word_array(text: Column) -> Column:
    return words(ascii_lower(text_or_empty(text)))


def shingle_hashes(text: Column, n: int = N) -> Column:
    return F.array_distinct(shingles(_word_array(text), n, F.xxhash64))


def shingle_texts(text: Column, n: int = N) -> Column:
    return F.array_distinct(shingles(_word_array(text), n, lambda *x: F.concat_ws(" ", *x)))


def item_sketches(spark: SparkSession, items: DataFrame, threshold: float, n: int = N) -> DataFrame:
    """(item_id, n_item, part, h): the bottom-k sketch of every item with its size partition; written."""
    hashed = items.select("item_id", F.sort_array(shingle_hashes(F.col("text"), n)).alias("hs")).where(F.size("hs") > 0)
    k = F.floor(F.lit(1 - threshold + 1e-9) * F.size("hs")).cast("int") + 1
    return keep(spark, hashed.select("item_id", F.size("hs").alias("n_item"), F.floor(F.log2(F.size("hs"))).cast("int").alias("part"),
                                     F.explode(F.slice("hs", F.lit(1), k)).alias("h")), "item-sketches")


def candidates(spark: SparkSession, docs: DataFrame, sketches: DataFrame, threshold: float, n: int = N) -> DataFrame:
    """(cand_doc, cand_item) pairs that share a sketch hash and whose sizes allow containment; written."""
    parts = sketches.groupBy("part").agg(F.min("n_item").alias("least"), F.max("h").alias("cut")).orderBy("part").collect()  # one row per power of two
    sizes = F.size("hs")
    cut = F.greatest(*[F.when(sizes >= F.lit(threshold * p["least"]), F.lit(p["cut"])) for p in parts], F.lit(None).cast("long")) if parts else F.lit(None).cast("long")
    hashed = docs.select(F.col("doc_id").alias("cand_doc"), shingle_hashes(F.col("text"), n).alias("hs"))
    probes = hashed.select("cand_doc", sizes.alias("n_doc"), cut.alias("cut"), F.explode("hs").alias("h")).where(F.col("h") <= F.col("cut"))
    sk = sized(sketches.select(F.col("item_id").alias("cand_item"), "n_item", "h"))
    found = probes.join(sk, "h").where(F.col("n_doc") >= F.lit(threshold) * F.col("n_item") - 1e-9)
    return keep(spark, found.select("cand_doc", "cand_item").distinct(), "leak-candidates")


def leaks(spark: SparkSession, docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, n: int = N) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) of every leaked item, for every document."""
    docs = docs.select("doc_id", "text")
    cand = candidates(spark, docs, item_sketches(spark, items, threshold, n), threshold, n)
    ids = keep(spark, cand.select("cand_doc").distinct(), "leak-docs")
    read = docs.join(sized(ids), docs["doc_id"].eqNullSafe(ids["cand_doc"]), "left_semi").select("doc_id", shingle_texts(F.col("text"), n).alias("in_doc"))
    whole = keep(spark, items.select("item_id", shingle_texts(F.col("text"), n).alias("in_item")).distinct(), "leak-items")
    c = sized(cand)
    pairs = read.join(c, read["doc_id"].eqNullSafe(c["cand_doc"])).join(sized(whole), F.col("cand_item").eqNullSafe(F.col("item_id")))
    counted = pairs.select("doc_id", "item_id", F.size("in_item").cast("long").alias("n_item"), F.size(F.array_intersect("in_item", "in_doc")).cast("long").alias("n_shared"))
    best = counted.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_shared", "n_item")).alias("b")).select("doc_id", "item_id", "b.n_item", "b.n_shared")
    return best.where(F.col("n_shared") >= F.lit(threshold) * F.col("n_item") - 1e-9).withColumn("containment", F.col("n_shared") / F.col("n_item"))


def decontaminate(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the documents that hold a benchmark item."""
    with tracked() as made:
        bad = keep(spark, leaks(spark, docs, items).select(F.col("doc_id").alias("bad_doc")).distinct(), "leaked-docs")
        drop(*[t for t in made if t is not bad])
    return docs.join(sized(bad), docs["doc_id"].eqNullSafe(bad["bad_doc"]), "left_anti")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def leaks_sql(docs: str = "documents") -> str:
    """CTEs that end in `leaked(doc_id, item_id, n_item, n_shared)`."""
    sh = lambda t, i: (f"(SELECT DISTINCT {i}, w[p] || ' ' || w[p+1] || ' ' || w[p+2] || ' ' || w[p+3] || ' ' || w[p+4] AS g FROM (SELECT {i}, w, unnest(range(1, len(w)-3)) AS p FROM "  # noqa: E731
                      f"(SELECT {i}, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM {t}) WHERE len(w) >= {N}))")
    return f"""
dsh AS {sh(docs, "doc_id")},
ish AS {sh("benchmark", "item_id")},
isz AS (SELECT item_id, count(*) AS n_item FROM ish GROUP BY item_id),
leaked AS (SELECT doc_id, item_id, any_value(n_item) AS n_item, count(*) AS n_shared FROM dsh JOIN ish USING (g) JOIN isz USING (item_id)
  GROUP BY doc_id, item_id HAVING count(*) >= {THRESHOLD} * any_value(n_item) - 1e-9)"""


OP1_SQL = f"""
WITH {leaks_sql().strip()}
SELECT doc_id, item_id, n_item, n_shared, n_shared::DOUBLE / n_item AS containment FROM leaked
"""
