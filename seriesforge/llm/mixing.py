"""Mixing sources to target weights (native).

Sources in code-point order (null last) take the weights in turn; together they share `budget` times all words.
A source's target stops at `cap` times its size, the excess goes to the others by weight (water level over the
sources sorted by cap/weight).  rate = target / size; a document is emitted floor(rate) times plus once more if its
seeded md5 coin falls under the fraction, so reruns and lost tasks give the same rows.

Defined results: null text has size 0; null source is a source of its own; rows with the same doc_id toss the same
coin; sources without words get target 0; an empty table gives an empty result.  Only the table of sources (one row
each, pre-aggregated on the map side) passes through one task; documents are never gathered by source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, sized, table, words

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET = 1.5
CAP = 2.0
SEED = "mix-1"


def targets(totals: DataFrame, weights=WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """totals(source, source_size) -> + weight, target."""
    everything = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last()))
    w = totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((rank - 1) % len(weights) + 1).cast("int")))
    w = w.withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    filled = everything.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    w = w.select("*", F.sum("most").over(filled).alias("full"), F.sum("weight").over(filled).alias("done"),
                 F.sum("weight").over(everything).alias("all_weight"), (F.lit(float(budget)) * F.sum("source_size").over(everything)).alias("share"))
    # Level if all before this source are full.  It rises while sources overfill and falls after, so the true one is the largest.
    level = (F.col("share") - (F.col("full") - F.col("most"))) / (F.col("all_weight") - (F.col("done") - F.col("weight")))
    w = w.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return w.select("source", "source_size", "weight", F.least(F.col("most"), F.col("level") * F.col("weight")).alias("target"))


def coin(doc_id: Column, seed: str = SEED) -> Column:
    """Uniform in [0, 1) from the id alone."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def copies(rate: Column, doc_id: Column) -> Column:
    return F.floor(rate) + F.when(coin(doc_id) < rate - F.floor(rate), 1).otherwise(0)


def size_of(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def rates(spark: SparkSession, sizes: DataFrame) -> DataFrame:
    """sizes(source, size) -> written table (at_source, source_size, target, rate)."""
    t = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    return keep(spark, t.select(F.col("source").alias("at_source"), "source_size", "target",
                                F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate")), "mix-rates")


def mix_plan(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every document."""
    sizes = keep(spark, docs.select("doc_id", "source", size_of(F.col("text")).alias("size")), "mix-sizes")
    r = rates(spark, sizes)
    joined = sizes.join(sized(r), sizes["source"].eqNullSafe(r["at_source"]), "left")
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * copies(F.col("rate"), F.col("doc_id"))).cast("long").alias("taken"))


def mixed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents of the mix, each as many times as it is taken; columns of docs, whatever their names."""
    r = rates(spark, docs.select("source", size_of(F.col("text")).alias("size")))
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["source"].alias("of"), docs["doc_id"].alias("id"))
    joined = whole.join(sized(r), F.col("of").eqNullSafe(F.col("at_source")), "left")
    times = copies(F.col("rate"), F.col("id")).cast("int")
    return joined.select("row", F.explode(F.array_repeat(F.lit(1), times)).alias("one")).select("row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(spark, table(spark, sf_dir, "documents"))


def mix_sql(docs: str = "documents") -> str:
    """CTEs that end in `rated(source, source_size, target, rate)`."""
    return f"""
sized AS (SELECT *, CAST(len(regexp_extract_all(coalesce(text,''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM {docs}),
tot AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
wt AS (SELECT *, CASE (row_number() OVER (ORDER BY source COLLATE "C" ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 2.0::DOUBLE * source_size AS most FROM tot),
cum AS (SELECT *, sum(most) OVER o AS full_, sum(w) OVER o AS done, sum(w) OVER () AS aw, 1.5::DOUBLE * sum(source_size) OVER () AS share FROM wt
  WINDOW o AS (ORDER BY most / w, source ASC NULLS LAST ROWS UNBOUNDED PRECEDING)),
lv AS (SELECT *, (share - (full_ - most)) / (aw - (done - w)) AS l FROM cum),
lv2 AS (SELECT *, max(l) OVER () AS level FROM lv),
rated AS (SELECT source, source_size, least(most, level * w) AS target,
  CASE WHEN source_size > 0 THEN least(most, level * w) / source_size ELSE 0.0::DOUBLE END AS rate FROM lv2)"""


COPIES_SQL = f"""(CAST(floor(rate) AS BIGINT) + CASE WHEN CAST(('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR),'')),1,8)) AS UINTEGER)::DOUBLE / 4294967296.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END)"""

OP7_SQL = f"""
WITH {mix_sql().strip()}
SELECT doc_id, size, source_size, target, CAST(size * {COPIES_SQL} AS BIGINT) AS taken
FROM sized s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source
"""
