"""The corpus pipeline: documents through five operators, each stage on all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from seriesforge.llm.common import drop, keep, table, tracked
from seriesforge.llm.decontamination import decontaminate, leaks_sql
from seriesforge.llm.line_dedup import dedup_sql, without_frequent_lines
from seriesforge.llm.mixing import COPIES_SQL, mix_sql, mixed
from seriesforge.llm.ngram_join import N, PERCENT, join_sql, one_of_each
from seriesforge.llm.quality_rules import keep_good, quality_sql


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Tables that results of earlier stages read.
_read: list[DataFrame] = []


def stage(make: Stage) -> Stage:
    """A stage whose tables go when a later stage gets docs that are written and read again, as STAGES are run."""
    @wraps(make)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if _read:
            files = docs.inputFiles()
            done = [t for t in _read if not any(f"/{t.scratch_path.rpartition('/')[2]}/" in f for f in files)]
            drop(*done)
            _read[:] = [t for t in _read if t not in done]
        with tracked() as made:
            out = make(spark, docs, sf_dir)
        _read.extend(made)
        return out

    return run_stage


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules, or whose domain does, go."""
    return keep_good(spark, docs)


@stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in many documents go; text is what is left, the other columns stay as they are."""
    return without_frequent_lines(spark, docs)


@stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: five-word shingles, similarity 0.8 or more."""
    return one_of_each(spark, docs, N, PERCENT)


@stage
def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate(spark, docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as the mix takes them."""
    return mixed(spark, docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram jaccard join", near_copies), ("benchmark decontamination", benchmark), ("mixing", mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, make in STAGES[:-1]:
        docs = keep(spark, make(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        drop(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = f"""
WITH RECURSIVE {quality_sql("documents").strip()},
stage1 AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars FROM qdocs d JOIN judged USING (qid) WHERE kept),
{dedup_sql("stage1").strip()},
stage2 AS (SELECT doc_id, new_text AS text, lang, source, n_chars FROM numbered JOIN deduped USING (rid)),
{join_sql("stage2", N, PERCENT).strip()},
stage3 AS (SELECT d.* FROM stage2 d JOIN linked l USING (doc_id) WHERE l.n_shingles = 0 OR l.component_id = d.doc_id),
{leaks_sql("stage3").strip()},
stage4 AS (SELECT * FROM stage3 WHERE doc_id NOT IN (SELECT doc_id FROM leaked)),
{mix_sql("stage4").strip()},
counted AS (SELECT s.doc_id, s.text, s.lang, s.source, s.n_chars, {COPIES_SQL} AS times FROM sized s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, text, lang, source, n_chars FROM (SELECT *, unnest(range(times)) AS copy_ FROM counted)
"""
