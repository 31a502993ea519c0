"""Corpus operators on small fixtures: SQL, brute force, nulls, empty and very long texts, ties, repeated rows, clashing columns."""

import hashlib
import html
import re
from collections import Counter, defaultdict

import pytest
from conftest import DATA, rows
from pyspark.sql import functions as F

import corpus_pipeline
from seriesforge import llm
from seriesforge.llm import decontamination, html_extraction, line_dedup, mixing, ngram_join, pii, quality_rules, rule_ensemble, toxicity, url_filters

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 5000}" for i in range(60_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, hot string, row long, n_words long, at_source string, rate double, node long"


def docs(spark, texts, **named):
    made = []
    for i, t in enumerate(texts):
        row = {"doc_id": i, "text": t, "lang": "en", "source": f"s{i % 2}", "n_chars": len(t or ""), "h": "x", "hot": "y", "row": 1, "n_words": 5, "at_source": "q", "rate": 1.0, "node": 3}
        row.update({k: v[i] for k, v in named.items()})
        made.append(tuple(row.values()))
    return spark.createDataFrame(made, SCHEMA)


def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, a repeated id."""
    base = "the quick brown fox jumps over the lazy dog while many small birds sing in the old green tree by the river "
    texts = [None, "", " \n\t ", LONG, base * 4, base * 4, base * 4, "one", "one two", "É É É\nÉ", base * 2 + "mail me a.b@c.de now", base]
    df = docs(spark, texts, doc_id=[0, 1, 2, 3, 4, 5, 5, 7, 8, None, 10, 11], source=[None, "a", "a", "b", "b", "b", "b", None, "", "a", "a", "b"])
    return df.union(df.where("doc_id = 4")).union(spark.createDataFrame([(None,) * 12], SCHEMA))


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_against_sql(spark, oracle, name):
    assert rows(llm.QUERIES[name](spark, DATA)) == oracle(llm.ORACLES[name], DATA)


def test_pipeline_against_sql(spark, oracle):
    assert rows(corpus_pipeline.run(spark, DATA)) == oracle(corpus_pipeline.ORACLE_SQL, DATA)


def test_pipeline_stages_keep_columns(spark):
    for df in (odd_docs(spark), odd_docs(spark).limit(0)):
        out = df
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, DATA)
            assert out.columns == df.columns, name
            out.collect()


@pytest.mark.parametrize("n", [0, 99])
def test_odd_tables(spark, n):
    d = odd_docs(spark).limit(n)
    size = d.count()
    items = spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (4, "the quick brown fox jumps over the lazy dog")], "item_id long, text string")
    assert decontamination.leaks(spark, d, items).where("item_id <> 4").count() == 0
    assert decontamination.leaks(spark, d, items.limit(0)).count() == 0
    for run in (lambda x: ngram_join.jaccard_components(spark, x), lambda x: quality_rules.judge(spark, x), lambda x: pii.report(pii.find(spark, x)), lambda x: mixing.mix_plan(spark, x),
                lambda x: line_dedup.dedup_lines(spark, x), lambda x: rule_ensemble.score(x, rule_ensemble.RuleEnsemble([], 0.0)), lambda x: toxicity.tagged(x, toxicity.train([], []))):
        assert run(d).count() == size


def test_leaks_partly_and_in_long_texts(spark):
    item = " ".join(f"q{i}" for i in range(30))  # 26 shingles
    one, two = item.replace("q15", "zz"), item.replace("q10", "zz").replace("q20", "zz")
    got = rows(decontamination.leaks(spark, docs(spark, [LONG + " " + item.upper() + " " + LONG, one, two, LONG + " " + one]), spark.createDataFrame([(7, item)], "item_id long, text string")).select("doc_id", "n_shared"))
    assert got == [(0, 26), (1, 21), (3, 21)]
    assert 21 / 26 >= 0.8 > 16 / 26


def brute_components(texts, n, percent):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append(frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset())
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [(root(i), i, len(s)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80)])
def test_join_against_brute_force(spark, n, percent):
    import random
    r = random.Random(4)
    texts = [None, "", "a", "A", "a b", "a b", "É x y z"]
    for base in range(6):
        words = [f"v{r.randrange(900)}" for _ in range(r.choice([8, 15, 40, 120, 400, 1500]))]
        for _ in range(14):
            w = list(words)
            for _ in range(r.randrange(0, max(2, len(w) // 25 if percent == 90 else len(w) // 18))):
                w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
            texts.append(" ".join(w))
    got = rows(ngram_join.jaccard_components(spark, docs(spark, texts), n, percent).select("component_id", "doc_id", F.col("n_shingles")))
    want = brute_components(texts, n, percent)
    assert got == sorted(want, key=repr)
    assert sum(c != d for c, d, _ in want) > 20  # there are links to find


def test_pairs_of_a_bucket_come_once(spark):
    """Nodes that share many signatures make a row for each pair, not one for each pair and signature; no pair is lost."""
    import random
    r = random.Random(6)
    held = {node: range(30) if node < 40 else r.sample(range(30), 9) for node in range(60)}
    side = spark.createDataFrame([(sig, node, node, 100, [0] * 8) for node, sigs in held.items() for sig in sigs], "sig long, node long, comp long, n long, sk array<long>")
    got = [tuple(p) for p in ngram_join._crossing(side, 90).collect()]
    want = {(a, b) for a in held for b in held if a < b and set(held[a]) & set(held[b])}
    assert set(got) == want and len(got) == len(want)


@pytest.mark.parametrize("stars", [0, 5])
def test_wide_buckets_against_brute_force(spark, monkeypatch, stars):
    """Chains of copies, each a little off the last: members of one bucket in many components."""
    import random
    r, texts = random.Random(8), []
    monkeypatch.setattr(ngram_join, "WIDE", 3)
    monkeypatch.setattr(ngram_join, "STARS", stars)
    for length in (60, 200):
        w = [f"v{r.randrange(900)}" for _ in range(length)]
        for k in range(60):
            if k % 20 == 0:
                w = [f"n{r.randrange(10**6)}" if r.random() < 0.05 else x for x in w]
            texts.append(" ".join(w))
            w[r.randrange(length)] = f"n{r.randrange(10**6)}"
    got = rows(ngram_join.jaccard_components(spark, docs(spark, texts), 3, 90).select("component_id", "doc_id", F.col("n_shingles")))
    assert got == sorted(brute_components(texts, 3, 90), key=repr)


@pytest.mark.parametrize("percent", [80, 90])
def test_unrelated_sets_share_no_signature_and_linked_ones_do(percent):
    import numpy as np
    rng = np.random.default_rng(5)
    random_set = lambda size: np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
    for size in (10, 60, 300, 900):
        seen = Counter(x for _ in range(400) for x in set(ngram_join.signatures(random_set(size), percent).tolist()))
        assert max(seen.values()) == 1, size
    linked = 0
    for _ in range(1500):
        s = random_set(int(rng.integers(2, 400)))
        gone, new = rng.integers(0, len(s) // 8 + 1, 2)
        a, b = s[rng.permutation(len(s))[gone:]], np.unique(np.concatenate([s, random_set(int(new))]))
        a.sort()
        if 100 * len(a) >= percent * len(b) and len(a) < len(b):
            linked += 1
            assert np.intersect1d(ngram_join.signatures(a, percent), ngram_join.signatures(b, percent)).size
    assert linked > 300


def test_screen_keeps_every_linked_set():
    import numpy as np
    rng = np.random.default_rng(6)
    random_set = lambda size: np.unique(rng.integers(0, 1 << 64, size, dtype=np.uint64))
    linked = 0
    for _ in range(1500):
        s = random_set(int(rng.integers(1, 300)))
        gone, new = rng.integers(0, len(s) // 7 + 1, 2)
        a, b = np.sort(s[rng.permutation(len(s))[gone:]]), np.unique(np.concatenate([s, random_set(int(new))]))
        if 100 * len(a) >= 80 * len(b):  # a lies in b: their Jaccard similarity
            linked += 1
            pa, pb = ngram_join._sample(a, 80), ngram_join._sample(b, 80)
            shared = len(np.intersect1d(pa, pb))
            assert shared >= len(pa) - len(a) * 20 // 100 and shared >= len(pb) - len(b) * 20 // 100
    assert linked > 500


def test_quality_and_mixing_edges(spark):
    got = {r["doc_id"]: r for r in quality_rules.judge(spark, docs(spark, [None, "a b c a b c x", "# $\n# $\n \n", LONG])).collect()}
    assert (got[1]["n_repeat_words"], got[2]["n_symbols"], got[2]["n_dup_lines"], got[3]["base_failed"]) == (6, 4, 1, True)
    plan = mixing.mix_plan(spark, docs(spark, ["a " * 100] * 40, source=[f"s{i % 4}" for i in range(40)])).collect()
    share = {r["target"] for r in plan}
    assert max(share) <= 2 * 1000 and all(r["taken"] <= 2 * r["size"] for r in plan)
    assert abs(sum({i % 4: r["target"] for i, r in enumerate(sorted(plan, key=lambda r: r["doc_id"]))}.values()) - 6000) < 1e-6
    bad = docs(spark, ["x y"] * 30 + ["word%d other%d " % (i, i) * 1 + " ".join(f"u{i}k{j}" for j in range(60)) for i in range(30)], source=["bad"] * 30 + ["good"] * 30)
    verdict = {r["doc_id"]: r["kept"] for r in quality_rules.judge(spark, bad).collect()}
    assert not any(verdict[i] for i in range(30)) and all(verdict[i] for i in range(30, 60))


def test_line_dedup_positions(spark):
    df = docs(spark, [f"  Shared Line \nown {i}\n\nshared line\nend" for i in range(10)] + ["shared line"])
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark, df).collect()}
    assert got[3]["text"] == "own 3\n" and (got[3]["n_lines"], got[3]["n_dropped"]) == (5, 3) and got[10]["text"] == ""


def base_spans(t):
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15)]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p, ok in kinds for m in re.finditer(p, t or "") if ok(m[0]))


def test_pii_against_brute_force(spark):
    texts = ["😀 a@b.c%x@d.e a.b+c@d-e.f.g. @x.y a@b", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112 " + "9" * 20_000, "+1 (499) 555-6503. +1 2 +49.30.123456789 +12345678901234567",
             None, "", "a" * 30_000 + "@", "é@é.é x\x01y\x02 q@w.ee"] + [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = {r["doc_id"]: r for r in pii.report(pii.find(spark, docs(spark, texts))).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t)
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), (i, want, got[i]["spans"])
        assert got[i]["spans"] == want or got[i]["spans"].startswith(want) and "term" in got[i]["spans"]


def test_pii_terms(spark):
    """A code word that is only ever near one address gives it away; a common word does not."""
    texts = [f"filler{i} talk{i} zebracorn wrote to boss@corp.example today{i} and the other{i}" for i in range(6)] + [f"the other thing number {i} is plain and the rest too " * 6 for i in range(60)]
    d = docs(spark, texts)
    found = pii.find(spark, d)
    got = {r["doc_id"]: r["spans"] for r in pii.report(found).collect()}
    at = texts[0].index("zebracorn")
    assert f"term:{at}:{at + 9}" in got[0] and got[10] == ""
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(found, d).collect()}
    assert "zebracorn" not in clean[0] and "[EMAIL]" in clean[0] and clean[10] == texts[10] and len(clean) == len(texts)


def test_pii_terms_of_one_context(spark):
    """An address seen once: a word found nowhere else gives it away, a common word does not."""
    texts = ["the other quuxname wrote to solo@corp.example and the rest"] + [f"the other thing number {i} wrote to and is plain and the rest too " * 6 for i in range(60)]
    got = {r["doc_id"]: r["spans"] for r in pii.report(pii.find(spark, docs(spark, texts))).collect()}
    at = texts[0].index("quuxname")
    assert f"term:{at}:{at + 8}" in got[0] and got[0].count("term") == 1 and got[10] == ""


@pytest.mark.parametrize("query,label,least", [("op3_quality_classifier", "quality", 0.97), ("op9_toxicity", "toxic", 0.93)])
def test_held_out_accuracy(spark, query, label, least):
    sf = "/root/testdata/sf0.01"
    out = llm.QUERIES[query](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").select("predicted", label, "score").collect()
    assert len(out) > 30 and all(0 <= r["score"] <= 1 for r in out)
    assert sum(r["predicted"] == r[label] for r in out) / len(out) >= least


def test_field_marginals_against_enumeration():
    import itertools
    import math
    f = toxicity.Field({}, 0.0, [[0.7, -0.2], [0.1, 0.9]], 1.0, 0.0)
    odds = [0.3, 2.0, 0.1, 5.0]
    total, toxic = 0.0, [0.0] * 4
    for tags in itertools.product((0, 1), repeat=4):
        v = math.prod(o if t else 1 for o, t in zip(odds, tags)) * math.exp(sum(f.move[a][b] for a, b in zip(tags, tags[1:])))
        total += v
        toxic = [x + v * t for x, t in zip(toxic, tags)]
    assert all(abs(a - b / total) < 1e-12 for a, b in zip(f.marginals(odds), toxic))


def test_distributed_training_equals_training_on_a_list(spark):
    import random
    r = random.Random(3)
    texts, y = [], []
    for i in range(120):
        bad = i % 3 == 0
        w = [f"w{r.randrange(300)}" for _ in range(r.choice([5, 60, 3000]))]
        for _ in range(3 if bad else 0):
            w[r.randrange(len(w))] = r.choice(["snarlbit", "grimpole"])
        texts.append(" ".join(w))
        y.append(int(bad))
    d = docs(spark, texts)
    labels = spark.createDataFrame([(i, v) for i, v in enumerate(y)], "doc_id long, toxic int")
    learnt = [r["doc_id"] for r in labels.where(~rule_ensemble.held_out(F.col("doc_id"))).collect()]
    one, two = toxicity.fit(spark, d, labels), toxicity.train([texts[i] for i in learnt], [y[i] for i in learnt])
    assert set(one.weights) == set(two.weights) and "w:snarlbit" in one.weights
    got = {r["doc_id"]: (r["score"], r["spans"]) for r in toxicity.tagged(d, one).collect()}
    assert all((got[i][0] >= 0.5) == bool(y[i]) for i in got)
    assert all(texts[i][s["start"]:s["end"]] in ("snarlbit", "grimpole") for i in got for s in got[i][1])


def test_tags_by_stretches_equal_one_pass_over_the_chain():
    import random
    r = random.Random(8)
    model = toxicity.Field({"w:bad": 2.5, "w:odd": 1.2}, -3.0, [[0.8, -0.4], [-0.2, 0.6]], 1.0, 0.0)
    for size in (1, 7, 90, 700):
        words = [r.choice(["bad", "odd"]) if r.random() < 0.03 else "x" for _ in range(size)]
        emissions = [model.emission(w) for w in words]
        import math
        whole = model.marginals([math.exp(model.plain + (e or 0.0)) for e in emissions])
        best, toxic = model.tag(emissions)
        assert toxic == [i for i, p in enumerate(whole) if p >= 0.5]
        if any(e is not None for e in emissions):
            assert abs(best - max(whole)) < 1e-6


def test_statistics_against_plain_python(spark):
    texts = [None, "", "A b. c! C,\nA b.\n\n x 12 #\nA b. c", "one two three one two three four"]
    for got, t in zip(rule_ensemble.with_stats(docs(spark, texts)).orderBy("doc_id").collect(), texts):
        t = t or ""
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        n, c, m = max(len(w), 1), max(len(t), 1), max(len(lines), 1)
        tri = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
        repeated = len({i + k for i in range(len(w) - 2) if tri[tuple(w[i:i + 3])] > 1 for k in range(3)})
        count = lambda p: len(re.findall(p, t))  # noqa: B023, E731
        want = {"n_words": len(w), "word_length": sum(map(len, w)) / n, "distinct": len(set(w)) / n, "repeated": repeated / n, "symbols": count(r"[#*$%&|<>]") / n,
                "dup_lines": (len(lines) - len(set(lines))) / m, "upper": count("[A-Z]") / c, "bangs": count("[!?]") / n, "commas": count(",") / n, "stops": count(r"\.") / n,
                "digits": count("[0-9]") / c, "line_words": len(w) / m}
        for k, v in want.items():
            assert abs(got[k] - v) < 1e-12, (t, k)


def test_names_of_columns_never_clash(spark):
    reserved = ["hot", "hot__", "copy__", "mix_rate__", "w__", "w", "lines", "row", "row__", "id", "in_doc", "kept", "rate", "of", "at_source", "one", "n_lines", "n_dropped", "key__", "root__"]
    d = docs(spark, ["a b c\nd " * 30, None, "x y"]).drop("h", "hot", "row", "n_words", "at_source", "rate", "node")
    for name in reserved:
        d = d.withColumn(name, F.lit(name))
    for run in (lambda x: line_dedup.without_frequent_lines(spark, x), lambda x: mixing.mixed(spark, x), lambda x: quality_rules.keep_good(spark, x), lambda x: ngram_join.one_of_each(spark, x),
                lambda x: quality_rules.base_counts(x), lambda x: rule_ensemble.with_stats(x)):
        out = run(d)
        assert [c for c in d.columns if c not in out.columns] == []
        assert all(r[name] == name for r in out.collect() for name in reserved)
    assert set(reserved) - set(line_dedup.dedup_lines(spark, d).columns) == set()


def test_ids_of_any_type(spark):
    d = docs(spark, ["a b c d e f g"] * 2 + ["h i"]).withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    assert rows(ngram_join.jaccard_components(spark, d).select("component_id", "doc_id")) == [("d0", "d0"), ("d0", "d1"), ("d2", "d2")]
    assert toxicity.tagged(d, toxicity.train([], [])).count() == 3
    pages = spark.createDataFrame([("p", "http://a.b/c", "<p>x</p>")], "page_id string, url string, html string")
    assert rows(html_extraction.main_texts(spark, pages)) == [(1, "p", "x", "http://a.b/c")]


def test_broken_markup_takes_linear_time():
    import time
    for page in ("<p>hello</p><img " + 'x="1" ' * 16_000, "<a " * 40_000, "<p>x" + "<" * 100_000, '<p a="' * 20_000, "<script>" + "</" * 50_000, "<!--" * 30_000, "<p class=" + "class= " * 15_000):
        began = time.time()
        html_extraction.parse(page)
        assert time.time() - began < 2
    assert html_extraction.extract("<p>a < b<br>c</p><p title='x>y'>d</p><p>e</p><img alt='", None, frozenset()) == "a < b c\nd\ne"


def test_host_verdicts_move_documents(spark):
    good, bad = " ".join(f"g{i}" for i in range(80)), "short"
    texts, source = [], []
    for host, n, failing in (("big", 400, 4), ("fine", 300, 3), ("farm", 200, 120), ("unlucky", 3, 2)):
        for i in range(n):
            texts.append(bad if i < failing else f"{good} {host} {i}")
            source.append(host)
    kept = {(r["source"], r["kept"]): r["n"] for r in quality_rules.judge(spark, docs(spark, texts, source=source)).join(
        docs(spark, texts, source=source).select("doc_id", "source"), "doc_id").groupBy("source", "kept").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert kept == {("big", True): 396, ("big", False): 4, ("fine", True): 297, ("fine", False): 3, ("farm", False): 200, ("unlucky", True): 1, ("unlucky", False): 2}


def test_secrets(spark):
    text = 'id a\x02b token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" then API_KEY: Zx81-abcdEF_9 and the token of love, token = no'
    found = pii.find(spark, docs(spark, [text]))
    got = pii.report(found).first()
    at = [p.split(":") for p in got["spans"].split(",") if p.startswith("secret")]
    assert [text[int(a):int(b)] for _, a, b in at] == ["04dbebab91ab85687d33eeaaf9ac699e1188f962", "Zx81-abcdEF_9"]
    assert got["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert "a\x02b" in pii.sanitised(found, docs(spark, [text])).first()["text"]


def test_rules_compile_to_the_same_scores(spark):
    import numpy as np
    r = np.random.default_rng(1)
    x = r.random((400, 2))
    y = ((x[:, 0] > 0.5) & (x[:, 1] <= 0.7)).astype(float)
    m = rule_ensemble.RuleEnsemble.fit(x, y, ("p", "q"))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in x], "p double, q double").select(m.column().alias("s"))
    s = np.array([row["s"] for row in df.collect()])
    assert ((s >= 0.5) == (y == 1)).mean() > 0.97 and 0 < len(m.rules) < 120


def brute_verdicts(url, rules):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]) if m else ("", "")
    fit = [(len(h + p), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fit)[2] if fit else None, max(fit)[1] if fit else "allow")


def test_urls_against_brute_force(spark):
    import random
    r = random.Random(2)
    label = lambda: r.choice(["a", "b", "a-b", "www", "com", "É"])
    rules = {(".".join(label() for _ in range(r.randrange(1, 4))), r.choice(["", "/", "/x", "/x/", "/y/z"])): r.choice(["allow", "block"]) for _ in range(40)}
    rules = [(h, p, v) for (h, p), v in rules.items()]
    urls = [None, "", "no scheme", "http://", "x://A.B", "://a/x?y", "http://a.b/x#://c/d"] + ["http://" + ".".join(label() for _ in range(r.randrange(1, 6))) + r.choice(["", "/", "/x", "/x/1?q=/y", "/y/z#a", "/xx"]) for _ in range(400)]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {row["page_id"]: (row["host"], row["path"], row["rule"], row["verdict"]) for row in url_filters.filter_urls(spark, df, url_filters.rules_table(spark, rules)).collect()}
    assert got == {i: brute_verdicts(u, rules) for i, u in enumerate(urls)}
    assert url_filters.filter_urls(spark, df.limit(0), url_filters.rules_table(spark)).count() == 0


def test_pages_against_article(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    for r in llm.QUERIES["op10_html_extraction"](spark, DATA).collect():
        inside = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        blocks = [re.sub(r"[\x20\x09-\x0D]+", " ", html.unescape(re.sub(r"<[^>]*>", "", b))).strip(" ") for b in re.split(r"</?p>|</?h1>", inside)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_page_regions(spark):
    page = ('<title>t</title><body><div id="sidebar"><p>side</p></div><header>head</header><div class="content"><h2>A &lt;i</h2><p>one <b>two</b> three<br>four<ul><li>a<li>b</ul>'
            '<form><p>no</p></form><section class="comments"><p>c</p></section></div><div class="footer-area">z</div><script>var a="<p>x</p>"</script>')
    df = spark.createDataFrame([(1, "http://h/1", page), (2, None, None), (3, "x", ""), (4, "http://h/2", "plain < text &amp; <p>" + "long " * 30_000), (4, "http://h/2", "a")], "page_id long, url string, html string")
    got = defaultdict(list)
    for r in html_extraction.main_texts(spark, df).collect():
        got[r["page_id"]].append(r["text"])
    assert got[1] == ["A <i\none two three four\na\nb"] and got[2] == got[3] == [""] and sorted(map(len, got[4]))[0] == 1
    assert Counter(len(v) for v in got.values())[2] == 1 and html_extraction.main_texts(spark, df.limit(0)).count() == 0


def test_template_text_goes(spark):
    """A run that stands on every page of a host is template; the same page elsewhere keeps it."""
    made = [(i, f"http://host/{i}", f"<div><div>Welcome to our site</div><p>story {i} text</p></div>") for i in range(8)] + [(99, "http://other/", "<div><div>Welcome to our site</div><p>x</p></div>")]
    got = {r["page_id"]: r["text"] for r in html_extraction.main_texts(spark, spark.createDataFrame(made, "page_id long, url string, html string")).collect()}
    assert got[3] == "story 3 text" and got[99] == "Welcome to our site\nx"


def test_nested_template_text_goes(spark):
    """Found once in each element of a list of any length, or twice on every page: template; a text that only some elements have is not."""
    made = [(i, f"http://host/{i}", "<div>Top</div>" + "".join(f"<li>Shared by <p>reader {i} {k}</p></li>" for k in range(1 + i % 3)) + "<ul><h4>Same words</h4></ul>" * (i % 2) + "<h4>own</h4>" + "<div>Top</div>") for i in range(12)]
    got = {r["page_id"]: r["text"] for r in html_extraction.main_texts(spark, spark.createDataFrame(made, "page_id long, url string, html string")).collect()}
    assert got[4] == "reader 4 0\nreader 4 1"


def _page_texts(spark, made):
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(made)], "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in html_extraction.main_texts(spark, df).collect()}


def test_main_slot_is_deduced(spark):
    """Without article, main or telling names: the slot with most of the host's text is found, what varies beside it goes."""
    page = "<body><div class='x{0}'><p>small {0}</p></div><div class='y'><h2>Title {0}</h2><p>{1}</p></div><div class='z'>more {0}</div></body>"
    got = _page_texts(spark, [(f"http://host/{i}", page.format(i, f"word{i} " * 30)) for i in range(6)] + [("http://few/1", page.format(1, "word"))])
    assert got[3] == "Title 3\n" + ("word3 " * 30).strip() and got[6] == "small 1\nTitle 1\nword\nmore 1"


def test_slot_and_template_inside_articles(spark):
    """A line on every article of a host goes; the paragraphs of a host of copies, and of a host with few pages, stay."""
    page = "<body><div>beside {0}</div><article><h1>T{0}</h1><p>{1}</p><p>Read more on our site</p></article></body>"
    varied = [(f"http://host/{i}", page.format(i, f"word{i} " * 40)) for i in range(12)]
    copies = [(f"http://copies/{i}", page.format(i, "the same story " * 9)) for i in range(12)]
    bare = [(f"http://bare/{i}", "<body><div>the same page</div></body>") for i in range(7)]
    few = [(f"http://few/{i}", page.format(i, f"w{i} " * 40)) for i in range(6)]
    got = _page_texts(spark, varied + copies + few + bare)
    assert got[5] == "T5\n" + ("word5 " * 40).strip()
    assert got[12] == "T0\n" + ("the same story " * 9).strip() + "\nRead more on our site"
    assert got[26] == "T2\n" + ("w2 " * 40).strip() + "\nRead more on our site" and got[33] == "the same page"


def test_near_copies_keep_their_text(spark):
    """Pages without article: near copies that make up a host keep what they share, and so do copies on a larger host, in blocks that only they have."""
    story, quote = "the story that all of them tell at some length " * 6, "a passage that somebody said " * 3
    alone = [(f"http://alone/{i}", f"<body><p>{story}</p><p>day {i}</p></body>") for i in range(7)]
    others = [(f"http://large/{i}", f"<body><p>word{i} {'other text ' * 9}{i}</p></body>") for i in range(14)]
    equal = [(f"http://large/c{i}", f"<body><p>{story}</p><blockquote>{quote}</blockquote></body>") for i in range(6)]
    nearly = [(f"http://large/n{i}", f"<body><p>{story} again</p><table><td>{quote}</td></table><p>day {i}</p></body>") for i in range(6)]
    got = _page_texts(spark, alone + others + equal + nearly)
    assert got[2] == f"{story.strip()}\nday 2"
    assert got[21] == f"{story.strip()}\n{quote.strip()}"
    assert got[27] == f"{story.strip()} again\n{quote.strip()}\nday 0"


def test_broadcasts_are_bounded(spark, monkeypatch):
    from seriesforge.llm import common
    small = common.keep(spark, spark.range(9).selectExpr("id", "array_repeat(id, 50) AS a"), "bounded")
    hinted = lambda df: "hint" in df._jdf.queryExecution().logical().toString().lower()
    assert hinted(common.sized(small))
    monkeypatch.setattr(common, "BROADCAST_BYTES", 100)
    assert not hinted(common.sized(small))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 8)
    assert not hinted(common.sized(small))
