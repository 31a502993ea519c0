"""Toxicity: a two-tag linear-chain conditional random field over words.

Training: a bounded sample of labelled documents (MAX_DOCS), each of them whole.  Executors count the features of documents, cut
the stretches around feature words and score the sample for calibration; the driver gets chosen features, at most MAX_CHAINS
stretches (those with the least hash of id and place) and one number a document.  Word and prefix
features that are MIN_RATIO times likelier in toxic documents tag their words as toxic there (the labels are of
whole documents, so these tags are the labelled tokens); all other words are plain.  The field has a weight for each such
feature, one for having none, and tag transitions; it is fitted by gradient ascent on the likelihood with
forward-backward expectations over the stretches around feature words.

Scoring: for two tags forward and backward messages are one ratio each, so a text is two passes of one fraction per
word.  Around words without features the ratios reach a fixed point within REACH words to rounding, so passes run over
the stretches around feature words of the whole text.  The strongest marginal, calibrated on the training documents,
is the document's score; words with a marginal of at least one half are the offending offsets.

Defined results: null or empty text scores as a text without feature words; without labels of both kinds every score is
the share of label 1 (0 without labels); null doc_id is held out; rows that repeat a doc_id each get a row; ids may have any type.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Collection, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from .common import drop, keep, table
from .rule_ensemble import held_out, sample_labels

MAX_DOCS = 8_000
MAX_CHAINS = 40_000
MIN_DOCS, MIN_RATIO, PREFIXES = 5, 12.0, (4, 5, 6, 7, 8)
REACH = 24
EPOCHS, RATE, RIDGE = 12, 0.3, 1e-3
THRESHOLD = 0.5
_EDGE = ".,;:!?()[]{}\"'*#%&$|<>"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def features(word: str) -> list[str]:
    core = word.lower().strip(_EDGE)
    return ["w:" + core, *[f"{n}:" + core[:n] for n in PREFIXES if len(core) > n]] if core else []


class Field:
    """weights: feature -> weight; plain: weight of a word without features; move[a][b]: transition a -> b (0 plain, 1 toxic)."""

    def __init__(self, weights: dict[str, float], plain: float, move: list[list[float]], scale: float, shift: float):
        self.weights, self.plain, self.move, self.scale, self.shift = weights, plain, move, scale, shift

    def emission(self, word: str) -> float | None:
        """Log odds that the word's features give; None if it has none."""
        hit = [self.weights[f] for f in features(word) if f in self.weights]
        return sum(hit) if hit else None

    def messages(self, odds: list[float]) -> tuple[list[float], list[float]]:
        """Forward and backward ratios (toxic over plain) of each word, from emission odds."""
        (oo, ot), (to, tt) = [[math.exp(x) for x in row] for row in self.move]
        ahead, r = [], None
        for e in odds:
            r = e if r is None else e * (ot + r * tt) / (oo + r * to)
            ahead.append(r)
        back, b = [1.0] * len(odds), 1.0
        for i in range(len(odds) - 1, 0, -1):
            b = (to + tt * odds[i] * b) / (oo + ot * odds[i] * b)
            back[i - 1] = b
        return ahead, back

    def marginals(self, odds: list[float]) -> list[float]:
        """P(toxic) of each word."""
        return [(f * b) / (1 + f * b) if f * b < 1e300 else 1.0 for f, b in zip(*self.messages(odds))]

    def tag(self, emissions: list[float | None]) -> tuple[float, list[int]]:
        """The strongest marginal and the positions of at least one half."""
        plain = math.exp(self.plain)
        at = [i for i, e in enumerate(emissions) if e is not None]
        best, toxic = max(self.marginals([plain] * min(len(emissions), 2 * REACH)), default=0.0) if not at else 0.0, []
        i = 0
        while i < len(at):
            j = i
            while j + 1 < len(at) and at[j + 1] - at[j] <= 2 * REACH:
                j += 1
            lo, hi = max(0, at[i] - REACH), min(len(emissions), at[j] + REACH + 1)
            m = self.marginals([plain if e is None else math.exp(min(e + self.plain, 600.0)) for e in emissions[lo:hi]])
            best = max(best, max(m))
            toxic += [lo + k for k, p in enumerate(m) if p >= 0.5]
            i = j + 1
        return best, toxic

    def score(self, best: float) -> float:
        p = min(max(best, 1e-9), 1 - 1e-9)
        return 1 / (1 + math.exp(-(self.scale * math.log(p / (1 - p)) + self.shift)))


def document_features(text: str | None) -> set[str]:
    return {f for w in set(_WORD.findall((text or "").lower())) for f in features(w)}


def likelier(seen: Iterable[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Feature -> log likelihood ratio of toxic and clean documents, for those over MIN_RATIO, from (feature, toxic, clean documents)."""
    ratio = {f: math.log((n + 0.5) / (toxic + 1)) - math.log((m + 0.5) / (clean + 1)) for f, n, m in seen if n >= MIN_DOCS}
    return {f: r for f, r in ratio.items() if r >= math.log(MIN_RATIO)}


def choose_features(texts: list[str], y: list[int]) -> dict[str, float]:
    seen = (Counter(), Counter())
    for text, label in zip(texts, y):
        seen[label].update(document_features(text))
    return likelier(((f, n, seen[0][f]) for f, n in seen[1].items()), y.count(1), y.count(0))


def chains_of(text: str | None, label: int, chosen: Collection[str], known: dict[str, list[str]]) -> Iterator[tuple[list[list[str]], list[int]]]:
    """(chosen features, tag) of each word of every stretch around feature words; a text without any gives its middle."""
    hits = []
    for w in _WORD.findall(text or ""):
        if w not in known:
            if len(known) > 200_000:
                known.clear()
            known[w] = [f for f in features(w) if f in chosen]
        hits.append(known[w])
    at = [i for i, h in enumerate(hits) if h] or [len(hits) // 2] * bool(hits)
    i = 0
    while i < len(at):
        j = i
        while j + 1 < len(at) and at[j + 1] - at[j] <= 8:
            j += 1
        part = hits[max(0, at[i] - 4):at[j] + 5]
        yield part, [int(bool(h) and label == 1) for h in part]
        i = j + 1


def constant(share: float) -> Field:
    s = min(max(share, 1e-3), 1 - 1e-3)
    return Field({}, -4.0, [[0.0, 0.0], [0.0, 0.0]], 0.0, math.log(s / (1 - s)))


def train(texts: list[str], y: list[int]) -> Field:
    """The field of a list of texts; fit() does the same from tables."""
    share = sum(y) / len(y) if y else 0.0
    if not 0 < share < 1:
        return constant(share)
    chosen, known = choose_features(texts, y), {}
    model = learned(sorted(chosen), [c for text, label in zip(texts, y) for c in chains_of(text, label, chosen, known)])
    return calibrated(model, [model.tag([model.emission(w) for w in _WORD.findall(text)])[0] for text in texts], y)


def learned(chosen: list[str], chains: list[tuple[list[list[str]], list[int]]]) -> Field:
    """Weights by gradient ascent over the chains in their order."""
    model = Field({f: 0.5 for f in chosen}, -2.0, [[1.0, 0.0], [0.0, 0.5]], 1.0, 0.0)
    for epoch in range(EPOCHS):
        rate = RATE / (1 + 0.5 * epoch)
        for part, tags in chains:
            odds = [math.exp(max(min(model.plain + sum(model.weights[f] for f in h), 30.0), -30.0)) for h in part]
            ahead, back = model.messages(odds)
            move, grad = [[math.exp(x) for x in row] for row in model.move], [[0.0, 0.0], [0.0, 0.0]]
            for i, (h, tag) in enumerate(zip(part, tags)):
                m = ahead[i] * back[i]
                step = rate * (tag - m / (1 + m))
                model.plain += 0.02 * step
                for f in h:
                    model.weights[f] += step / len(h) - rate * RIDGE * model.weights[f]
                if i:  # observed less expected moves; expected ones from both messages
                    joint = [[(1, ahead[i - 1])[c] * move[c][d] * (1, odds[i] * back[i])[d] for d in (0, 1)] for c in (0, 1)]
                    total = sum(map(sum, joint))
                    for c in (0, 1):
                        for d in (0, 1):
                            grad[c][d] += (tags[i - 1] == c and tag == d) - joint[c][d] / total
            for c in (0, 1):
                for d in (0, 1):
                    model.move[c][d] += 0.02 * rate * grad[c][d]
    return model


def calibrated(model: Field, strongest: list[float], y: list[int]) -> Field:
    """Scale and shift of the log odds of the strongest marginals, by logistic regression on the labels."""
    logit = []
    for best in strongest:
        p = min(max(best, 1e-9), 1 - 1e-9)
        logit.append(max(-12.0, min(12.0, math.log(p / (1 - p)))))
    a, b = 1.0, 0.0
    for _ in range(60):  # Newton's method with a small ridge
        ga, gb, haa, hab, hbb = -1e-2 * (a - 1), 0.0, 1e-2, 0.0, 1e-6
        for x, t in zip(logit, y):
            p = 1 / (1 + math.exp(-(a * x + b)))
            ga, gb, q = ga + (t - p) * x, gb + (t - p), p * (1 - p)
            haa, hab, hbb = haa + q * x * x, hab + q * x, hbb + q
        det = haa * hbb - hab * hab
        if det < 1e-9:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = max(0.05, a + max(-1.0, min(1.0, da))), b + max(-1.0, min(1.0, db))
        if abs(da) + abs(db) < 1e-7:
            break
    model.scale, model.shift = a, b
    return model


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Field:
    chosen = sample_labels(labels, label, MAX_DOCS)  # bounded by MAX_DOCS
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled"))
    rows = keep(spark, joined.select(F.xxhash64("doc_id", "text").alias("key"), (F.col("y") >= 1).cast("int").alias("y"), "text"), "toxic-labelled")
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    toxic, clean = counts.get(1, 0), counts.get(0, 0)
    if not toxic or not clean:
        drop(rows)
        return constant(1.0 if toxic else 0.0)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = list(document_features(text.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([y] * len(found), pa.int32())], names=["feature", "y"])

    seen = rows.select("y", "text").mapInArrow(counted, "feature string, y int").groupBy("feature").agg(F.sum("y").alias("n"), F.sum(1 - F.col("y")).alias("m"))
    often = seen.where((F.col("n") >= MIN_DOCS) & ((F.col("n") + 0.5) * (clean + 1) >= 0.99 * MIN_RATIO * (F.col("m") + 0.5) * (toxic + 1)))
    features_ = sorted(likelier(((r["feature"], r["n"], r["m"]) for r in often.collect()), toxic, clean))  # likely features of MIN_DOCS of MAX_DOCS documents
    wanted = frozenset(features_)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[str]] = {}
        for batch in batches:
            made = [(key, place, *chain) for key, y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2))
                    for place, chain in enumerate(chains_of(text.as_py(), y, wanted, known))]
            yield pa.RecordBatch.from_arrays([pa.array([m[c] for m in made], f.type) for c, f in enumerate(_CHAIN)], schema=_CHAIN)

    chains = rows.select("key", "y", "text").mapInArrow(cut, "key long, place long, words array<array<string>>, tags array<int>")
    some = chains.orderBy(F.xxhash64("key", "place"), "key", "place").limit(MAX_CHAINS).collect()  # bounded by MAX_CHAINS
    model = learned(features_, [(r["words"], r["tags"]) for r in sorted(some, key=lambda r: (r["key"], r["place"]))])
    best = strongest(rows.select("y", "text"), model).collect()  # a number for each of MAX_DOCS documents
    drop(rows)
    best = sorted((r["best"], r["y"]) for r in best)
    return calibrated(model, [b for b, _ in best], [y for _, y in best])


def strongest(rows: DataFrame, model: Field) -> DataFrame:
    """(y, best): the strongest marginal of every text of rows(y, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Emissions(model)
        for batch in batches:
            best = [model.tag(list(map(known.__getitem__, (t.as_py() or "").encode("utf-8", "surrogatepass").split())))[0] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.float64())], names=["y", "best"])

    return rows.mapInArrow(run, "y int, best double")


_CHAIN = pa.schema([("key", pa.int64()), ("place", pa.int64()), ("words", pa.list_(pa.list_(pa.string()))), ("tags", pa.list_(pa.int32()))])


class _Emissions(dict):
    LIMIT = 400_000

    def __init__(self, model: Field):
        super().__init__()
        self.model = model

    def __missing__(self, word: bytes) -> float | None:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = self.model.emission(word.decode("utf-8", "surrogatepass"))
        return value


def tagged(docs: DataFrame, model: Field) -> DataFrame:
    """(doc_id, score, spans array<struct<start,end>>) for every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Emissions(model)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            scores, spans = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                best, toxic = model.tag(list(map(known.__getitem__, text.encode("utf-8", "surrogatepass").split())))
                scores.append(model.score(best))
                if toxic:
                    at = [m.span() for m in _WORD.finditer(text)]
                    toxic = [{"start": at[i][0], "end": at[i][1]} for i in toxic]
                spans.append(toxic)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, kind)], names=["doc_id", "score", "spans"])

    span = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))
    return docs.select("doc_id", "text").mapInArrow(run, StructType([docs.schema["doc_id"], StructField("score", DoubleType()), StructField("spans", span)]))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = tagged(docs, fit(spark, docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"), "spans")
