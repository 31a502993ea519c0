"""Quality classifier: a sparse rule ensemble compiled into Spark columns.

Statistics of the whole text are Spark columns.  Small trees are boosted on a bounded sample of labelled rows, every
path from a root to a node becomes a conjunctive rule, a lasso logistic regression (accelerated proximal gradient)
keeps few of them, and the kept rules and weights become one Column expression: scoring needs no Python and no shuffle.

Labels are read only from rows whose crc32(doc_id as text) mod 5 is not 0; at most MAX_LABELS of them (those with
the least id hash) go to the driver, as a dozen numbers each.

Defined results: null or empty text has zero statistics and a score; without labels of both kinds every score is
the share of label 1 (0.5 without labels); null doc_id is held out; rows that repeat a doc_id each get a row; an empty
table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty, words
from .text_stats import SYMBOLS, beside, full_lines, removed, repeated_words

MAX_LABELS = 20_000
TREES, DEPTH, SHRINK, MIN_LEAF, CUTS = 24, 3, 0.3, 10, 24
LASSO, STEPS = 0.002, 400
THRESHOLD = 0.3
STATS = ("n_words", "word_length", "distinct", "repeated", "symbols", "dup_lines", "upper", "bangs", "commas", "stops", "digits", "line_words")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def with_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs + STATS (double; columns of these names give way); the shares are per word or per code point."""
    text = text_or_empty(F.col("text"))
    at_least_one = lambda c: F.greatest(c, F.lit(1)).cast("double")
    n, c, m = at_least_one(F.size("w")), at_least_one(F.length(text)), at_least_one(F.size("lines"))
    return beside(docs, text_col, {"w": words(F.col("text")), "lines": full_lines(text)}, {
        "n_words": F.size("w").cast("double"), "word_length": F.length(F.array_join("w", "")) / n, "distinct": F.size(F.array_distinct("w")) / n,
        "repeated": repeated_words(F.col("w")) / n, "symbols": removed(text, SYMBOLS) / n, "dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))) / m,
        "upper": removed(text, "[A-Z]") / c, "bangs": removed(text, "[!?]") / n, "commas": removed(text, ",") / n, "stops": removed(text, r"\.") / n,
        "digits": removed(text, "[0-9]") / c, "line_words": F.size("w") / m})


def sample_labels(labels: DataFrame, label: str, most: int) -> DataFrame:
    """(labelled, y) of at most `most` training rows, the same ones in each run."""
    rows = labels.where(~held_out(F.col("doc_id")) & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select(F.col("doc_id").alias("labelled"), "y")


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, path: tuple, rules: dict, out: np.ndarray, bins: list[np.ndarray]) -> None:
    if path:
        rules.setdefault(path, None)
    best = (1e-6, None)
    if len(path) < DEPTH and len(rows) >= 2 * MIN_LEAF:
        g, h = grad[rows].sum(), hess[rows].sum()
        for j, cuts in enumerate(bins):
            v = x[rows, j]
            for cut in cuts:
                left = v <= cut
                k = left.sum()
                if MIN_LEAF <= k <= len(rows) - MIN_LEAF:
                    gl, hl = grad[rows[left]].sum(), hess[rows[left]].sum()
                    gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                    if gain > best[0]:
                        best = (gain, (j, float(cut)))
    if best[1] is None:
        out[rows] = grad[rows].sum() / (hess[rows].sum() + 1)
        return
    j, cut = best[1]
    left = x[rows, j] <= cut
    _grow(x, grad, hess, rows[left], (*path, (j, "<=", cut)), rules, out, bins)
    _grow(x, grad, hess, rows[~left], (*path, (j, ">", cut)), rules, out, bins)


def extract_rules(x: np.ndarray, y: np.ndarray) -> list[tuple]:
    """Paths of boosted trees, the distinct ones in order."""
    bins = [np.unique(np.quantile(x[:, j], np.linspace(0.01, 0.99, CUTS))) for j in range(x.shape[1])]
    margin, rules = np.zeros(len(y)), {}
    for _ in range(TREES):
        p, out = 1 / (1 + np.exp(-margin)), np.zeros(len(y))
        _grow(x, y - p, p * (1 - p), np.arange(len(y)), (), rules, out, bins)
        margin += SHRINK * out
    return list(rules)


def rule_matrix(x: np.ndarray, rules: list[tuple]) -> np.ndarray:
    def holds(rule):
        return reduce(np.logical_and, [(x[:, j] <= cut) if op == "<=" else (x[:, j] > cut) for j, op, cut in rule])
    return np.column_stack([holds(r) for r in rules]).astype(float)


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float = LASSO, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and intercept by FISTA; the intercept is not penalised."""
    n = len(y)
    lip = (np.linalg.norm(z, 2) ** 2 + n) / (4 * n)
    w, b = np.zeros(z.shape[1]), 0.0
    v, vb, t = w.copy(), b, 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(z @ v + vb))) - y
        new = v - z.T @ r / n / lip
        new, nb = np.sign(new) * np.maximum(np.abs(new) - penalty / lip, 0), vb - r.mean() / lip
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = new, nb, t2
    return w, b


class RuleEnsemble:
    """rules with weights: [((column, op, cut), ...), weight], and an intercept in log odds."""

    def __init__(self, rules: list[tuple[tuple, float]], intercept: float):
        self.rules, self.intercept = rules, intercept

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, names=STATS) -> RuleEnsemble:
        share = y.mean() if len(y) else 0.5
        if not 0 < share < 1:
            share = min(max(share, 1e-3), 1 - 1e-3)
            return cls([], float(np.log(share / (1 - share))))
        found = extract_rules(x, y)
        if not found:
            return cls([], float(np.log(share / (1 - share))))
        w, b = lasso_logistic(rule_matrix(x, found), y)
        return cls([(tuple((names[j], op, cut) for j, op, cut in r), float(v)) for r, v in zip(found, w) if v], float(b))

    def column(self) -> Column:
        def holds(rule) -> Column:
            return reduce(lambda a, b: a & b, [(F.col(c) <= cut) if op == "<=" else (F.col(c) > cut) for c, op, cut in rule])
        margin = reduce(lambda a, b: a + b, [F.when(holds(r), F.lit(w)).otherwise(F.lit(0.0)) for r, w in self.rules], F.lit(self.intercept))
        return 1 / (1 + F.exp(-margin))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> RuleEnsemble:
    chosen = sample_labels(labels, label, MAX_LABELS)  # bounded by MAX_LABELS
    rows = with_stats(docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled"))).select("doc_id", "y", *STATS).toPandas()
    rows = rows.sort_values(["doc_id", *STATS], kind="stable")
    return RuleEnsemble.fit(rows[list(STATS)].to_numpy(float), (rows["y"].to_numpy(float) >= 1).astype(float))


def score(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    scored = with_stats(docs.select("doc_id", "text")).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.column().alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
