"""Host-level quality rules (native).

Every document is judged by rules over its whole text; failures are summed by domain (the `source` column) with
map-side partial counts, each domain's failure rate is shrunk towards the corpus by a beta prior whose strength is
fitted to the spread of the domain rates (moments).  A domain is rejected if, for some rule, its posterior puts a chance of 95
percent or more (normal approximation) on a rate above the limit: ODDS times the corpus's odds of failing, and LEAST_RATE
at least, so that no domain goes for the sake of a few bad documents.  The verdict is joined back to the documents.

Defined results: null or empty text has no words and fails the length rule; null source is a domain of its own; an
empty table gives an empty result; repeated rows are judged one by one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, sized, table
from .text_stats import base_counts

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOL_PERCENT = 30
#: Repeated lines for each hundred words: texts made of short lines that repeat.
MAX_DUP_LINE_PERCENT = 10
#: A domain's rate is too high above ODDS times the corpus's odds, and above LEAST_RATE; CERTAIN: the normal quantile of 95 percent.
ODDS, LEAST_RATE, CERTAIN = 3.0, 0.25, 1.645


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def rule_columns() -> dict[str, Column]:
    return {
        "f_short": F.col("n_words") < MIN_WORDS,
        "f_repeat": 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"),
        "f_symbols": 100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("n_words"),
        "f_dup_lines": 100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("n_words"),
    }


def _too_high(failed: Column, n: Column, m: Column, s: Column) -> Column:
    """The beta posterior of a domain's rate lies above the limit."""
    rate = (failed + s * m) / (n + s)
    limit = F.greatest(F.lit(LEAST_RATE), ODDS * m / (1 - m + ODDS * m))
    return rate - CERTAIN * F.sqrt(rate * (1 - rate) / (n + s + 1)) > limit


def host_verdicts(spark: SparkSession, counted: DataFrame, host_col: str = "source") -> DataFrame:
    """(at_host, host_ok) from documents with base counts; written.

    Prior of a rule: mean m = corpus rate, strength s = m(1-m)/v - 1 with v the variance of the host rates in excess
    of sampling noise (weighted by documents), at least 1; no excess: 1e6 (all hosts take the corpus rate).
    """
    rules = list(rule_columns())
    by_host = keep(spark, counted.select(F.col(host_col).alias("at_host"), *[c.cast("long").alias(k) for k, c in rule_columns().items()])
                   .groupBy("at_host").agg(F.count(F.lit(1)).alias("n"), *[F.sum(k).alias(k) for k in rules]), "host-failures")
    total = by_host.agg(F.sum("n").alias("all_docs"), F.sum(F.lit(1)).alias("all_hosts"), *[F.sum(k).alias(f"t_{k}") for k in rules])
    means = by_host.join(F.broadcast(total), F.lit(True))  # total and prior are one row each
    spread = means.groupBy("all_docs", "all_hosts", *[f"t_{k}" for k in rules]).agg(
        *[F.sum(F.col("n") * F.pow(F.col(k) / F.col("n") - F.col(f"t_{k}") / F.col("all_docs"), 2.0)).alias(f"v_{k}") for k in rules])
    prior = spread
    for k in rules:
        m, h, n = F.col(f"t_{k}") / F.col("all_docs"), F.col("all_hosts"), F.col("all_docs")
        noise = m * (1 - m) * h / n
        excess = F.col(f"v_{k}") / n - noise
        prior = prior.withColumn(f"m_{k}", m).withColumn(f"s_{k}", F.when(excess > 0, F.greatest(F.lit(1.0), m * (1 - m) / excess - 1)).otherwise(1e6))
    prior = prior.select(*[f"{p}_{k}" for p in "ms" for k in rules])
    shrunk = by_host.join(F.broadcast(prior), F.lit(True))
    ok = reduce(lambda a, b: a & b, [~_too_high(F.col(k), F.col("n"), F.col(f"m_{k}"), F.col(f"s_{k}")) for k in rules])
    return keep(spark, shrunk.select("at_host", ok.alias("host_ok")), "host-verdicts")


def judge(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, base counts, base_failed, kept) for every document; one pass over the texts."""
    counted = keep(spark, base_counts(docs.select("doc_id", "source", "text")).drop("text"), "base-counts")
    v = host_verdicts(spark, counted)
    joined = counted.join(sized(v), counted["source"].eqNullSafe(v["at_host"]), "left")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"),
                         (~base_failed() & F.col("host_ok")).alias("kept"))


def keep_good(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns of docs; the texts are read and counted once and not shuffled."""
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row__"), docs["source"].alias("source__"), docs["text"].alias("text__"))
    counted = base_counts(whole, "text__").drop("text__").withColumn("row__", F.when(~base_failed(), F.col("row__")))
    flagged = keep(spark, counted, "quality-rows")
    v = host_verdicts(spark, flagged, "source__").where("host_ok").select(F.col("at_host").alias("at_host__"))
    return flagged.where(~base_failed()).join(sized(v), F.col("source__").eqNullSafe(F.col("at_host__")), "left_semi").select("row__.*")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark, table(spark, sf_dir, "documents"))


def quality_sql(docs: str = "documents") -> str:
    """CTEs that end in `judged(rid, ..., base_failed, kept)`, rid from `qdocs`."""
    per_rule = lambda f: ", ".join(f(k) for k in ("f_short", "f_repeat", "f_symbols", "f_dup_lines"))
    return f"""
qdocs AS (SELECT *, row_number() OVER () AS qid FROM {docs}),
qw AS (SELECT qid, regexp_extract_all(coalesce(text,''), '[^\\x20\\x09-\\x0D]+') AS w, coalesce(text,'') AS t FROM qdocs),
win AS (SELECT qid, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g FROM (SELECT qid, w, unnest(range(1, len(w)-1)) AS i FROM qw WHERE len(w) >= 3)),
rep AS (SELECT qid, i FROM win QUALIFY count(*) OVER (PARTITION BY qid, g) > 1),
cov AS (SELECT qid, count(DISTINCT p) AS n_repeat_words FROM (SELECT qid, unnest([i, i+1, i+2]) AS p FROM rep) GROUP BY qid),
dl AS (SELECT qid, count(*) - count(DISTINCT l) AS n_dup_lines FROM (SELECT qid, unnest(string_split(t, chr(10))) AS l FROM qw) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY qid),
bc AS (SELECT qid, d.doc_id, d.source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM qw JOIN qdocs d USING (qid) LEFT JOIN cov USING (qid) LEFT JOIN dl USING (qid)),
fl AS (SELECT *, (n_words < {MIN_WORDS})::INT AS f_short, (100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)::INT AS f_repeat,
  (100 * n_symbols > {MAX_SYMBOL_PERCENT} * n_words)::INT AS f_symbols, (100 * n_dup_lines > {MAX_DUP_LINE_PERCENT} * n_words)::INT AS f_dup_lines FROM bc),
ho AS (SELECT source, count(*) AS n, {per_rule(lambda k: f"sum({k}) AS {k}")} FROM fl GROUP BY source),
tt AS (SELECT sum(n) AS bign, count(*) AS bigh, {per_rule(lambda k: f"sum({k}) / sum(n)::DOUBLE AS m_{k}")} FROM ho),
vv AS (SELECT {per_rule(lambda k: f"sum(n * pow({k} / n::DOUBLE - m_{k}, 2)) / any_value(bign) - any_value(m_{k} * (1 - m_{k}) * bigh / bign) AS x_{k}")} FROM ho, tt),
pr AS (SELECT {per_rule(lambda k: f"m_{k}, CASE WHEN x_{k} > 0 THEN greatest(1.0::DOUBLE, m_{k} * (1 - m_{k}) / x_{k} - 1) ELSE 1e6::DOUBLE END AS s_{k}")} FROM tt, vv),
hv AS (SELECT source, {" AND ".join(f"NOT (r_{k} - {CERTAIN}::DOUBLE * sqrt(r_{k} * (1 - r_{k}) / (n + s_{k} + 1)) > greatest({LEAST_RATE}::DOUBLE, {ODDS}::DOUBLE * m_{k} / (1 - m_{k} + {ODDS}::DOUBLE * m_{k})))" for k in ("f_short", "f_repeat", "f_symbols", "f_dup_lines"))} AS host_ok FROM (SELECT *, {per_rule(lambda k: f"({k} + s_{k} * m_{k}) / (n + s_{k}) AS r_{k}")} FROM ho, pr)),
judged AS (SELECT qid, doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (f_short + f_repeat > 0) AS base_failed, (f_short + f_repeat = 0 AND host_ok) AS kept
  FROM fl JOIN hv ON fl.source IS NOT DISTINCT FROM hv.source)"""


OP5_SQL = f"""
WITH {quality_sql().strip()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged
"""
