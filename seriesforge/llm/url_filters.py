"""URL filters by a sorted sweep over reversed-host keys (native).

A host becomes its labels in reverse, each ended by \\x01 (``www.example.com`` -> ``com\\x01example\\x01www\\x01``),
so a rule on a host is the key interval that starts with the rule's key, and intervals are nested or disjoint.
Distinct host keys and rule keys are range-partitioned together and swept in key order; the sweep keeps one
slot per nesting depth (the stack of active rules).  In key order all descendants of a host follow it without a
gap, so the last rule host of depth d is the active one of that depth, if any is.  Each range block starts from the
rules that are already open at its first key.  Rules of a host carry their path prefixes; the longest rule wins.

Defined results: null url or no ``://`` gives empty host and path and the default verdict; repeated urls each get
their row; equal rules with both verdicts: block wins; empty tables give empty results; extra columns are kept out.
The rule table is taken to be a configuration (rules of one host are gathered in one row); urls may be of any number,
a host's urls meet only as one distinct key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, keep, sized, table, text_or_empty

#: (host, path, verdict) of the production query.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
DEFAULT = "allow"
_URL = r"://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(text_or_empty(url), _URL, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(text_or_empty(url), _URL, 2)


def host_key(host: Column) -> Column:
    return F.concat(F.concat_ws("\x01", F.reverse(F.split(host, r"\."))), F.lit("\x01"))


def judge_hosts(spark: SparkSession, hosts: DataFrame, rules: DataFrame, blocks: int = 0) -> DataFrame:
    """hosts(host), rules(host, path, verdict) -> (host, stack array<struct<rule, path, verdict, size>>)."""
    blocks = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    grouped = (
        rules.withColumn("rule", F.concat("host", "path"))
        .groupBy(host_key(F.col("host")).alias("key"))
        .agg(F.collect_set(F.struct("rule", "path", "verdict", F.length("rule").alias("size"))).alias("own"))
    )
    own_type = grouped.schema["own"].dataType.simpleString()
    rule_keys = keep(spark, grouped, "url-rules")
    depth = rule_keys.agg(F.max(F.size(F.split("key", "\x01")) - 1)).first()[0] or 0
    keys = hosts.select(host_key(F.col("host")).alias("key"), "host").distinct()
    events = keys.select("key", "host", F.lit(None).cast(own_type).alias("own")).unionByName(
        rule_keys.select("key", F.lit(None).cast("string").alias("host"), "own"))
    swept = keep(spark, events.repartitionByRange(blocks, "key").withColumn("block", F.spark_partition_id()), "url-sweep")
    first = swept.groupBy("block").agg(F.min("key").alias("start"))
    labels = F.split("start", "\x01")
    opened = first.select("block", F.explode(F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
        lambda n: F.concat(F.concat_ws("\x01", F.slice(labels, F.lit(1), n)), F.lit("\x01")))).alias("key"))
    seeds = opened.join(rule_keys, "key").select("key", F.lit(None).cast("string").alias("host"), "own", "block")
    order = Window.partitionBy("block").orderBy("key", F.col("host").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    at_depth = F.size(F.split("key", "\x01")) - 1
    slots = [F.last(F.when(F.col("own").isNotNull() & (at_depth == d), F.struct("key", "own")), ignorenulls=True).over(order).alias(f"slot{d}")
             for d in range(1, depth + 1)]
    rows = swept.unionByName(seeds).select("key", "host", *slots).where(F.col("host").isNotNull())
    stack = F.array(*[F.when(F.col("key").startswith(F.col(f"slot{d}.key")), F.col(f"slot{d}.own")) for d in range(1, depth + 1)]) if depth else F.array().cast(f"array<{own_type}>")
    return rows.select("host", F.flatten(F.filter(stack, lambda x: x.isNotNull())).alias("stack"))


def filter_urls(spark: SparkSession, pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """(id, host, path, rule, verdict) for every row of pages."""
    urls = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    stacks = keep(spark, judge_hosts(spark, urls.select("host"), rules), "url-stacks").withColumnRenamed("host", "at_host")
    joined = urls.join(sized(stacks), F.col("host") == F.col("at_host"), "left")
    fits = F.filter("stack", lambda r: F.col("path").startswith(r["path"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(r["size"].alias("size"), r["verdict"].alias("verdict"), r["rule"].alias("rule"))))
    return (joined.withColumn("best", best)
            .select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict")))


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark, table(spark, sf_dir, "pages"), rules_table(spark))


OP2_SQL = """
WITH rules(rhost, rpath, v) AS (VALUES ('com','/','allow'),('example.com','/en/','block'),('www.example.com','/en/','allow'),('net','/es/','block'),('net','/fr/','block')),
u AS (SELECT page_id, translate(regexp_extract(coalesce(url,''),'://([^/?#]*)([^?#]*)',1),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url,''),'://([^/?#]*)([^?#]*)',2) AS path, row_number() OVER () AS rid FROM pages),
m AS (SELECT rid, arg_max(rhost||rpath, length(rhost||rpath)) AS rule, arg_max(v, length(rhost||rpath)) AS verdict
  FROM u JOIN rules ON (host = rhost OR ends_with(host, '.'||rhost)) AND starts_with(path, rpath) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(verdict,'allow') AS verdict FROM u LEFT JOIN m USING (rid)
"""
