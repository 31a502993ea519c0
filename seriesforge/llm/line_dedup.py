"""Line dedup: lines whose normalised key is found in many documents are dropped everywhere.

Keys (trimmed, A-Z lower-cased) are hashed to 64 bits; each document sends its distinct hashes only; counting is
pre-aggregated on the map side, so a line found in a third of all documents is a handful of partial counts.  The
hashes over the threshold are joined back by document and the kept lines are put together again in their order.

Defined results: null or empty text is one empty line, which is never dropped; rows that share a doc_id (null
included) are one document when counting, and each gets its own row; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CHARS, ascii_lower, drop, keep, sized, table, text_or_empty

MIN_DOCS = 10
MIN_KEY = 1


def line_hash(line: Column, min_key: int = MIN_KEY) -> Column:
    """Null for keys that are too short to count."""
    key = F.btrim(line, F.lit(SPACE_CHARS))
    return F.when(F.length(key) >= min_key, F.xxhash64(ascii_lower(key)))


def lines_of(text: Column) -> Column:
    return F.split(text_or_empty(text), "\n")


def frequent_lines(spark: SparkSession, docs: DataFrame, min_docs: int = MIN_DOCS, min_key: int = MIN_KEY) -> DataFrame:
    """(doc_id, hot array<long>) for the documents that hold a line found in min_docs documents or more; written."""
    hashes = F.array_distinct(F.transform(lines_of(F.col("text")), lambda x: line_hash(x, min_key)))
    seen = keep(spark, docs.select(F.col("doc_id").alias("in_doc"), F.explode(hashes).alias("h")).where("h IS NOT NULL"), "line-hashes")
    hot = keep(spark, seen.distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("h"), "line-hot")
    found = keep(spark, seen.join(sized(hot), "h").groupBy("in_doc").agg(F.collect_set("h").alias("hot")), "line-docs")
    drop(seen, hot)
    return found


def _kept_lines(spark: SparkSession, docs: DataFrame, min_docs: int, min_key: int) -> DataFrame:
    """(row, n_lines, kept array<string>) of every row; the columns of docs are inside row, so their names can't clash with any here."""
    hot = frequent_lines(spark, docs, min_docs, min_key)
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].alias("id"), lines_of(docs["text"]).alias("lines"))
    joined = whole.join(sized(hot), F.col("id").eqNullSafe(F.col("in_doc")), "left")
    kept = F.when(F.col("hot").isNull(), F.col("lines")).otherwise(
        F.filter("lines", lambda x: ~F.coalesce(F.array_contains(F.col("hot"), line_hash(x, min_key)), F.lit(False))))
    return joined.select("row", F.size("lines").cast("long").alias("n_lines"), kept.alias("kept"))


def dedup_lines(spark: SparkSession, docs: DataFrame, min_docs: int = MIN_DOCS, min_key: int = MIN_KEY) -> DataFrame:
    """docs with text replaced by the kept lines, and n_lines, n_dropped added (columns of these names give way)."""
    rest = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    return _kept_lines(spark, docs, min_docs, min_key).select(*rest, F.array_join("kept", "\n").alias("text"), "n_lines", (F.col("n_lines") - F.size("kept")).cast("long").alias("n_dropped"))


def without_frequent_lines(spark: SparkSession, docs: DataFrame, min_docs: int = MIN_DOCS, min_key: int = MIN_KEY) -> DataFrame:
    """docs, all columns as they are, with text replaced by the kept lines."""
    done = _kept_lines(spark, docs, min_docs, min_key)
    return done.select(*[F.array_join("kept", "\n").alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(spark, docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


_KEY = "translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def dedup_sql(docs: str = "documents") -> str:
    """CTEs that end in `deduped(rid, n_lines, n_dropped, new_text)`, rid from `numbered`."""
    return f"""
numbered AS (SELECT *, row_number() OVER () AS rid FROM {docs}),
split_ AS (SELECT rid, doc_id, string_split(coalesce(text,''), chr(10)) AS ls FROM numbered),
ln AS (SELECT rid, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM split_),
kd AS (SELECT *, {_KEY} AS k FROM ln),
hot AS (SELECT k FROM (SELECT DISTINCT k, doc_id FROM kd WHERE k <> '') GROUP BY k HAVING count(*) >= {MIN_DOCS}),
deduped AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (k IN (SELECT k FROM hot)) AS n_dropped,
  coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (k NOT IN (SELECT k FROM hot)), '') AS new_text FROM kd GROUP BY rid)"""


OP8_SQL = f"""
WITH {dedup_sql().strip()}
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_dropped AS BIGINT) AS n_dropped, sha256(new_text) AS kept_sha256
FROM numbered JOIN deduped USING (rid)
"""
