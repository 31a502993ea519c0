"""Personal data: patterns, and information-theoretic sanitisation of the terms around them (native).

Base spans (email, ip, card, phone) come from leftmost matches over the whole text, secrets (values given to a name like token,
password or api_key) likewise.  Each match is a mention of a protected entity; its context is the CONTEXT code points on either side.  Contexts are counted once each, so copies
of a passage are no evidence.  For entity e and term t with p(t|e) the share of e's contexts that hold t and p(t)
the chance that a context of the corpus holds t (from the term's count over all texts), and p(t|e) drawn towards it by
PRIOR contexts, so that an entity with one or two contexts is scored too:

    PMI(e;t) = log2(p(t|e) / p(t)),   IC(e) = log2(contexts in the corpus / contexts of e)

A term whose PMI is at least DISCLOSE * IC(e) gives e away: it becomes a span
of kind `term` in every document that mentions e.  sanitised() puts a label for each span (generalisation).

Patterns are written so that Java's matcher is linear: possessive repeats (nothing after them could use what they give
back) and an anchor that a run is tried from its start only.

Defined results: null or empty text has no spans; rows that share a doc_id are one document for disclosure and each
get a row; \\x01 and \\x02 in texts count as one code point each; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, keep, let, sized, table, text_or_empty, words

KINDS = ("email", "ip", "card", "phone", "secret", "term")
CONTEXT = 120
PRIOR = 1.0
DISCLOSE = 0.8
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A name of a secret, what stands between it and its value, and the value.
_NAMED = r"(?i:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|secret[_-]?key|auth[_-]?key|client[_-]?secret)"
SECRET = rf"({_NAMED}[\"']?\x20{{0,3}}[:=]\x20{{0,3}}[\"']?)([A-Za-z0-9+/_=.~-]{{8,}}+)"
_SPAN = "array<struct<kind:int,start:int,end:int,value:string>>"
_EDGE = ".,;:!?()[]{}\"'"


def _luhn(value: Column) -> Column:
    digits = F.reverse(F.regexp_replace(value, "[^0-9]", ""))
    def total(d: Column) -> Column:
        each = F.transform(F.split(d, ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
        return F.aggregate(each, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))
    return let(digits, lambda d: F.when(F.length(d).between(16, 19), total(d) % 10 == 0).otherwise(False))


def _good(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: let(F.ltrim(p, F.lit("0")), lambda z: (F.length(z) == 0) | ((F.length(z) <= 3) & (F.try_to_number(z, F.lit("999")) <= 255))))
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(8, 15)
    return F.lit(True)


def _marked_spans(marked: Column, kind: int, good) -> Column:
    """Spans between \\x01 and \\x02, in code points of the text without the marks."""
    def step(acc: Column, part: Column) -> Column:
        value = F.substring_index(part, "\x02", 1)
        here = F.struct(F.lit(kind).alias("kind"), acc["off"].alias("start"), (acc["off"] + F.length(value)).alias("end"), value.alias("value"))
        return F.struct((acc["off"] + F.length(part) - 1).alias("off"), F.when(good(value), F.concat(acc["out"], F.array(here))).otherwise(acc["out"]).alias("out"))

    def over(parts: Column) -> Column:
        start = F.struct(F.length(F.get(parts, F.lit(0))).alias("off"), F.array().cast(_SPAN).alias("out"))
        return F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), start, step)["out"]

    return F.when(F.contains(marked, F.lit("\x01")), let(F.split(marked, "\x01"), over)).otherwise(F.array().cast(_SPAN))


def plain(text: Column) -> Column:
    """The text without null and without the two marks; as many code points."""
    return F.regexp_replace(text_or_empty(text), "[\x01\x02]", "\x03")


def base_spans(text: Column) -> Column:
    """Spans of a plain() text by kind, then start."""
    found = [_marked_spans(F.regexp_replace(text, f"({p})", "\x01$1\x02"), i, lambda v, k=k: _good(k, v)) for i, (k, p) in enumerate(PATTERNS.items())]
    first = {"email": "@", "phone": "+"}
    found = [F.when(F.contains(text, F.lit(first[k])), s).otherwise(F.array().cast(_SPAN)) if k in first else s for k, s in zip(PATTERNS, found)]
    return F.concat(*found)


def secret_spans(text: Column, base: Column) -> Column:
    """Values of secrets that no base span touches."""
    spans = _marked_spans(F.regexp_replace(text, SECRET, "$1\x01$2\x02"), KINDS.index("secret"), lambda v: F.lit(True))
    free = lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return F.when(F.rlike(text, F.lit(_NAMED)), F.filter(spans, free)).otherwise(F.array().cast(_SPAN))


def term_of(word: Column) -> Column:
    return ascii_lower(F.btrim(word, F.lit(_EDGE)))


def term_spans(text: Column, terms: Column, base: Column) -> Column:
    """Words whose term is in `terms` and that no base span touches."""
    marked = F.regexp_replace(text, r"([^\x20\x09-\x0D]+)", "\x01$1\x02")
    free = lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return F.filter(_marked_spans(marked, KINDS.index("term"), lambda v: F.array_contains(terms, term_of(v))), free)


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def mentions(found: DataFrame) -> DataFrame:
    """(doc_id, entity, ctx, terms) for every span of found(doc_id, text, named)."""
    one = found.select("doc_id", "text", F.explode("named").alias("s")).select("doc_id", "text", "s.*")
    # The outermost word of each side may be cut by the window, so it does not count.
    left = F.regexp_replace(F.substring(F.col("text"), F.greatest(F.col("start") - CONTEXT + 1, F.lit(1)), F.least(F.col("start"), F.lit(CONTEXT))), r"^[^\x20\x09-\x0D]*", "")
    right = F.regexp_replace(F.substring(F.col("text"), F.col("end") + 1, F.lit(CONTEXT)), r"[^\x20\x09-\x0D]*$", "")
    context = ascii_lower(F.concat(left, F.lit(" "), right))
    terms = F.filter(F.array_distinct(F.transform(words(context), lambda w: F.btrim(w, F.lit(_EDGE)))), lambda t: F.length(t) > 1)
    return one.select("doc_id", F.xxhash64("kind", F.lower("value")).alias("entity"), F.xxhash64(context).alias("ctx"), terms.alias("terms"))


def disclosing(spark: SparkSession, docs: DataFrame, said: DataFrame) -> DataFrame:
    """(entity, term) pairs over the disclosure threshold; written."""
    contexts = keep(spark, said.select("entity", "ctx").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_e")), "pii-entities")
    with_terms = said.select("entity", "ctx", F.explode("terms").alias("term")).distinct()
    pairs = keep(spark, with_terms.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_et")).join(sized(contexts), "entity"), "pii-pairs")
    cand = keep(spark, pairs.select("term").distinct(), "pii-terms")
    all_words = docs.select(F.explode(F.split(text_or_empty(F.col("text")), SPACE)).alias("w")).select(term_of(F.col("w")).alias("term"))
    counts = keep(spark, all_words.groupBy("term").agg(F.count(F.lit(1)).alias("tf")).join(sized(cand), "term"), "pii-counts")
    length = docs.agg(F.sum(F.length("text")).alias("chars"))
    total = keep(spark, length.select((F.coalesce(F.col("chars"), F.lit(0)) / (2.0 * CONTEXT) + 1.0).alias("n_ctx")), "pii-total")  # one row
    scored = pairs.join(sized(counts), "term").join(F.broadcast(total), F.lit(True))
    p_t = F.least(F.lit(1.0), F.col("tf") / F.col("n_ctx"))
    pmi, ic = F.log2((F.col("n_et") + PRIOR * p_t) / (F.col("n_e") + PRIOR) / p_t), F.log2(F.greatest(F.col("n_ctx") / F.col("n_e"), F.lit(1.0)))
    return keep(spark, scored.where((pmi > 0) & (pmi >= DISCLOSE * ic)).select("entity", "term"), "pii-disclosing")


def find(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans, text) for every row of docs; spans holds the base ones, the secrets and the disclosing terms, text is
    there where spans are."""
    docs = docs.select("doc_id", F.col("text").alias("raw"), plain(F.col("text")).alias("text"))
    found = docs.withColumn("base", base_spans(F.col("text"))).withColumn("named", F.concat("base", secret_spans(F.col("text"), F.col("base"))))
    some = F.size("named") > 0
    base = keep(spark, found.select("doc_id", "base", "named", F.when(some, F.col("text")).alias("text"), F.when(some, F.col("raw")).alias("raw")), "pii-base")
    said = keep(spark, mentions(base.where(some)), "pii-mentions")
    told = disclosing(spark, docs, said)
    # Only terms that the document holds: an entity's documents times all its terms would grow with the square.
    held = base.where(some).select("doc_id", F.explode(F.array_distinct(F.transform(words(F.col("text")), term_of))).alias("term"))
    held = keep(spark, held.join(sized(keep(spark, told.select("term").distinct(), "pii-told")), "term", "left_semi").distinct(), "pii-held")
    named = said.select(F.col("doc_id").alias("in_doc"), "entity").distinct()
    by_doc = held.join(named, held["doc_id"].eqNullSafe(named["in_doc"])).join(sized(told), ["entity", "term"])
    by_doc = keep(spark, by_doc.groupBy("in_doc").agg(F.collect_set("term").alias("told")), "pii-docs")
    joint = base.join(sized(by_doc), base["doc_id"].eqNullSafe(by_doc["in_doc"]), "left")
    extra = F.when(F.col("told").isNotNull() & F.col("text").isNotNull(), term_spans(F.col("text"), F.col("told"), F.col("named"))).otherwise(F.array().cast(_SPAN))
    return joint.select("doc_id", "base", F.concat("named", extra).alias("spans"), F.col("raw").alias("text"))


def report(found: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def sanitised(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, text) with every span replaced by its label in brackets; where spans overlap, the first one counts."""
    held = found.where(F.size("spans") > 0)
    order = F.sort_array(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(acc: Column, s: Column) -> Column:
        new = F.concat(acc["out"], F.array(F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.get(names, s["kind"])))
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), new.alias("out")))

    done = F.aggregate(order, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), step,
                       lambda a: F.concat(F.array_join(a["out"], ""), F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    clean = held.select("doc_id", done.alias("text"))
    rest = docs.select("doc_id", "text").join(held.select(F.col("doc_id").alias("held")).distinct(), docs["doc_id"].eqNullSafe(F.col("held")), "left_anti")
    return rest.unionByName(clean)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(find(spark, table(spark, sf_dir, "documents")))
