"""N-gram Jaccard join by PartEnum signatures, and its connected components.

A document's set holds its distinct shingles of n words (64-bit hashes); with fewer words the whole sequence is one.
Two documents link when 100 |A n B| >= percent |A u B|, that is when the symmetric difference is at most
(100 - percent) / (100 + percent) of |A| + |B|.  The general rule is five words and 80 percent.

PartEnum: sizes are cut into bands that grow by a constant ratio; a set takes part in its own band and in every band that
a larger partner can lie in, so each pair meets in the band of its larger set, where the difference is at most a k that the
band's largest size gives.  The feature domain is split by a hash into parts of which any m + 1 have at most one difference
each; a part is split into pieces, of which all but one are equal then.  For each part and each piece left out the sum of the
other elements' hashes is a signature: linked sets share at least m + 1 of them.

Slots without elements would be shared by unrelated sets.  A set with empty slots in at most m parts needs none of them: of
m + 1 good parts one has none.  A set with more joins each empty slot with every signature of a second, independent partition of
its elements (and so on, DEPTH deep): linked sets share one there too.  So nothing is lost and no bucket is a constant.

Equal sets form one class (node); only nodes are compared.  Below 90 percent, where a shingle gives a signature or more, sets
that cannot link get none: a linked set lacks at most (100 - percent) percent of its shingles in its partner, so of those of
its shingles that lie in a fixed range of the hash domain all but that many are found in some other node, which has the same
range counted.  A set with fewer is linked with nothing; the others go on, whatever they share.  A signature is live if two nodes have it; once the
live ones are counted, a bit filter lets few others pass to the second shuffle.  First each bucket compares its
members to its least node only (linear), links are verified by exact intersection and components taken; wide buckets that
still span several components meet a few more of their members in the same way, as long as that links anything; then buckets
that still do compare their cross-component pairs, each pair in few of the buckets that it shares, after a 512-bit parity
sketch (its Hamming distance never exceeds the symmetric difference) has removed hopeless ones inside the join.  Nothing is
gathered by bucket: hot buckets are joins that adaptive execution splits.

Defined results: null or empty text has an empty set, is linked with nothing, and is its own component; rows that repeat a
doc_id each get a row; a null doc_id never becomes a component's smallest id unless the component has no other; ids may have
any type that can be ordered; an empty table gives an empty result.  Nodes are 64-bit digests of a set's sorted shingle hashes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import cache, lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import drop, keep, possible, sized, table

#: The general rule of near-copy stages, and that of the op4 query.
N, PERCENT = 5, 80
OP4_N, OP4_PERCENT = 3, 90
BAND_RATIO = 1.3
#: Pieces of a part: two (fewer signatures) where each then holds this many elements or more, else three.
FULL_PIECE = 8
DEPTH = 4
#: A shingle gives some 0.2 signatures at 90 percent, 1.2 at 80.  Below this percentage sets are screened first ...
SCREENED_BELOW = 90
#: ... over a range that holds this many times the share of shingles that a linked set may lack (0.35 of all at 80 percent).
SCREEN = 1.75
#: Pairs are verified in this many parts, one after the other, so that each part's files are gone before the next.
PARTS = 2
#: Buckets with more members than WIDE that span several components first meet STARS more of their members, one after the other.
WIDE, STARS = 32, 3
#: Signatures before a bucket's own, by which pairs that have met are told.
LAST = 16
SKETCH_WORDS = 8
_M = np.uint64(0x9E3779B97F4A7C15)


class _WordHash(dict):
    """bytes -> 64-bit hash, remembered; forgotten when full so that memory stays bounded."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, seen: _WordHash, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes.  bytes.lower() and bytes.split() know ASCII only, as the word rule does."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(seen.__getitem__, w), np.uint64, len(w))
    if not len(h):
        return h
    m = min(n, len(h))
    s = np.full(len(h) - m + 1, m, np.uint64)
    for i in range(m):
        s = s * _M + h[i:len(h) - m + 1 + i]
    s = np.sort(_mix(s))
    return s[np.concatenate([[True], s[1:] != s[:-1]])]


def node_of(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.md5(s.tobytes()).digest()[:8], "little", signed=True)


def _bands(limit: int) -> list[int]:
    out = [2]
    while out[-1] < limit:
        out.append(max(out[-1] + 1, int(out[-1] * BAND_RATIO)))
    return out


_BANDS = np.array(_bands(1 << 40))


@cache
def band_scheme(largest: int, percent: int) -> tuple[int, int, int] | None:
    """(parts, pieces, m) of the band with that largest size; None if only equal sets can link.

    m + 1 parts are sure to have at most one difference.  m is chosen for the fewest signatures over the sizes that take part,
    where a slot is empty with probability exp(-expected elements).
    """
    k = 2 * largest * (100 - percent) // (100 + percent)
    if not k:
        return None
    pieces = 2 if largest / (k // 2 + 1) / 2 >= FULL_PIECE else 3

    def signatures_of(m: int) -> float:
        slots, total = (k // 2 + 1 + m) * pieces, 0.0
        for share in (percent / 100 / BAND_RATIO, 1 / BAND_RATIO, 1.0):
            empties = slots * math.exp(-share * largest * (pieces - 1) / slots)
            term = upto = math.exp(-empties)
            for i in range(1, m + 1):
                term *= empties / i
                upto += term
            more = max(0.0, 1 - upto) * max(empties, m + 1)
            total += slots * sum(more ** depth for depth in range(DEPTH + 1))
        return total

    m = min(range(0, 8 + k // 2), key=signatures_of)
    return k // 2 + 1 + m, pieces, m


def _partition(place: np.ndarray, weight: np.ndarray, scheme: tuple[int, int, int], seed: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Signatures of the slots with elements; of the empty ones; whether these are needed."""
    parts, pieces, m = scheme
    cell = (place % np.uint64(parts * pieces)).astype(np.int64)
    sums = np.zeros(parts * pieces, np.uint64)
    np.add.at(sums, cell, weight)
    sums, counts = sums.reshape(parts, pieces), np.bincount(cell, minlength=parts * pieces).reshape(parts, pieces)
    empty = counts.sum(axis=1, keepdims=True) == counts
    slot = _slots(parts * pieces, seed).reshape(parts, pieces)
    made = _mix((sums.sum(axis=1, keepdims=True) - sums) ^ slot)
    if not empty.any():
        return made.ravel(), slot[:0].ravel(), False
    return made[~empty], slot[empty], bool(empty.any(axis=1).sum() > m)


@lru_cache(maxsize=4096)
def _slots(n: int, seed: int) -> np.ndarray:
    return _mix(np.arange(n, dtype=np.uint64) * _M + _mix(np.array([seed], np.uint64) * _M + np.uint64(1)))


def _band_signatures(s: np.ndarray, place: np.ndarray, weight: np.ndarray, scheme: tuple[int, int, int], seed: int, depth: int = 1) -> np.ndarray:
    made, slots, needed = _partition(place, weight, scheme, seed)
    if not needed:
        return made
    more = np.zeros(1, np.uint64)
    if depth < DEPTH:  # another partition, independent of this one
        salt = _mix(np.array([depth], np.uint64))
        more = _band_signatures(s, _mix(s ^ salt), _mix(s + salt), scheme, seed + 1, depth + 1)
    return np.concatenate([made, _mix(slots[:, None] ^ _mix(more + _M)[None, :]).ravel()])


def signatures(s: np.ndarray, percent: int) -> np.ndarray:
    """All PartEnum signatures of a set."""
    size, out = len(s), []
    if not size:
        return s
    place, weight = _mix(s ^ np.uint64(0x5851F42D4C957F2D)), _mix(s + _M)
    first, last = np.searchsorted(_BANDS, [size, size * 100 // percent])
    for band in range(first, last + 1):
        scheme = band_scheme(int(_BANDS[band]), percent)
        if scheme:
            out.append(_band_signatures(s, place, weight, scheme, (band << 20) + percent * 100))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def sketch(s: np.ndarray) -> np.ndarray:
    """Parities of the counts in 512 cells."""
    cells = np.bincount((_mix(s ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - 9)).astype(np.int64), minlength=64 * SKETCH_WORDS)
    return np.packbits((cells & 1).astype(np.uint8)).view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays).view(np.int64)))


def _in_parts(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of a batch with the shingle sets of the last column."""
    seen = _WordHash()
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            yield part, [shingle_set(t.as_py(), seen, n) for t in part.column(part.num_columns - 1)]


def _nodes(sets: list[np.ndarray]) -> pa.Array:
    return pa.array([node_of(s) if len(s) else None for s in sets], pa.int64())


def _sample(s: np.ndarray, percent: int) -> np.ndarray:
    """Those of a sorted set that lie in the range of the hash domain over which sets are screened."""
    share = min(1.0, SCREEN * (100 - percent) / 100)
    return s[:np.searchsorted(s, np.uint64(min(int(share * 2.0 ** 64), 2 ** 64 - 1)), "right")]


def _features(docs: DataFrame, n: int, made: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(doc_id, n, node, sk, sigs) of every row, where sigs is what `made` takes from its set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _in_parts(batches, n):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), _nodes(sets), _lists([sketch(s) if len(s) else s for s in sets]),
                                              _lists([made(s) for s in sets])], names=["doc_id", "n", "node", "sk", "sigs"])

    longs = ArrayType(LongType())
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), StructField("n", LongType()), StructField("node", LongType()), StructField("sk", longs), StructField("sigs", longs)])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _signed(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(node, sigs) of every row with a set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _in_parts(batches, n):
            sets = [s for s in sets if len(s)]
            if sets:
                yield pa.RecordBatch.from_arrays([_nodes(sets), _lists([signatures(s, percent) for s in sets])], names=["node", "sigs"])

    return docs.select("text").mapInArrow(run, "node long, sigs array<long>")


def _items(docs: DataFrame, n: int) -> DataFrame:
    """(node, items) of every row with a set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _in_parts(batches, n):
            sets = [s for s in sets if len(s)]
            if sets:
                yield pa.RecordBatch.from_arrays([_nodes(sets), _lists(sets)], names=["node", "items"])

    return docs.select("text").mapInArrow(run, "node long, items array<long>")


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, comp) for edges(a, b): least label of neighbours and a pointer jump, until nothing changes."""
    both = keep(spark, edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = keep(spark, both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp"), F.lit(True).alias("moved")), "cc-0")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m"))
        step = keep(spark, labels.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "m").alias("comp")), "cc-step")
        jump = step.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        new = keep(spark, step.join(jump, "comp").select("node", F.col("up").alias("comp"), (F.col("was") != F.col("up")).alias("moved")), "cc-jump")
        drop(labels, step)
        labels = new
        if not labels.where("moved").limit(1).count():
            drop(both)
            return labels


def _verified(spark: SparkSession, docs: DataFrame, nodes: DataFrame, pairs: DataFrame, n: int, percent: int) -> list[DataFrame]:
    """Those of pairs(a, b) whose sets really link, by exact intersection, in PARTS parts one after the other; written."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "root"), "node")
    roots = keep(spark, ends.select(F.col("root").alias("root__"), F.xxhash64("root").alias("key__")).distinct(), "join-roots")
    pages, among = possible(spark, roots, "key__")
    texts = among(docs.withColumn("key__", F.xxhash64("doc_id")), "key__").join(sized(roots.select("root__")), F.col("doc_id").eqNullSafe(F.col("root__")), "left_semi").select("text")
    sets = keep(spark, _items(texts, n).dropDuplicates(["node"]), "join-sets")
    parts = []
    for at in range(PARTS):
        left = pairs.where(F.pmod("a", F.lit(PARTS)) == at).join(sets.select(F.col("node").alias("a"), F.col("items").alias("ia")), "a")
        both = left.join(sets.select(F.col("node").alias("b"), F.col("items").alias("ib")), "b")
        shared = both.select("a", "b", F.size(F.array_intersect("ia", "ib")).alias("i"), (F.size("ia") + F.size("ib")).alias("t"))
        parts.append(keep(spark, shared.where(100 * F.col("i") >= percent * (F.col("t") - F.col("i"))).select("a", "b"), "join-links"))
    drop(roots, pages, sets)
    return parts


def _copies(spark: SparkSession, ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """(copy__, key__): the ids whose sets are all equal to others' of a lesser id; written."""
    roots = nodes.select(F.col("root").alias("root__")).distinct()
    copies = ids.where("node IS NOT NULL").select(F.col("doc_id").alias("copy__")).distinct().join(roots, F.col("copy__").eqNullSafe(F.col("root__")), "left_anti")
    return keep(spark, copies.select("copy__", F.xxhash64("copy__").alias("key__")), "join-copies")


def _originals(feats: DataFrame, copies: DataFrame, maybe: Callable[..., DataFrame]) -> DataFrame:
    """(node, sigs) of feats without the copies; only rows that may be copies are shuffled for it."""
    marked = maybe(feats.where("node IS NOT NULL").select("doc_id", "node", "sigs", F.xxhash64("doc_id").alias("key__")), "key__", True)
    checked = marked.where("passed__").join(sized(copies.select("copy__")), F.col("doc_id").eqNullSafe(F.col("copy__")), "left_anti")
    return marked.where("NOT passed__").select("node", "sigs").unionAll(checked.select("node", "sigs"))


def _shared(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """(sig, node) of the signatures in rows(node, sigs) that several rows have; written."""
    rows = rows.select("node", F.explode("sigs").alias("sig"))
    live = keep(spark, rows.groupBy("sig").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("sig"), "join-live")
    pages, among = possible(spark, live, "sig")
    shared = keep(spark, among(rows, "sig").join(live, "sig", "left_semi").select("sig", "node"), "join-shared")
    drop(live, pages)
    return shared


def _linkable(spark: SparkSession, docs: DataFrame, nodes: DataFrame, rows: DataFrame, n: int, percent: int) -> DataFrame:
    """(node, sigs) with the signatures of the nodes that rows(node, sigs), their samples, let link with another; written.

    nodes has the size of each sample as `p`.  A few more sets may come along (hash bits decide which documents are read): that costs work, no link.
    """
    met = _shared(spark, rows)
    found = met.groupBy("node").agg(F.count(F.lit(1)).alias("met"))
    least = F.col("p") - F.expr(f"n * {100 - percent} div 100")
    some = nodes.join(found, "node", "left").where(F.coalesce("met", F.lit(0)) >= least)
    keys = keep(spark, some.select(F.xxhash64("root").alias("key__")).distinct(), "join-linkable")
    drop(met)
    pages, among = possible(spark, keys, "key__")
    signed = keep(spark, _signed(among(docs.withColumn("key__", F.xxhash64("doc_id")), "key__"), n, percent), "join-signed")
    drop(keys, pages)
    return signed


def _near(x: str, y: str, percent: int):
    """Sizes and sketches of both sides allow a link."""
    bits = F.aggregate(F.zip_with(f"{x}.sk", f"{y}.sk", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, b: s + b)
    return (100 * F.least(f"{x}.n", f"{y}.n") >= percent * F.greatest(f"{x}.n", f"{y}.n")) & ((100 + percent) * bits <= (100 - percent) * (F.col(f"{x}.n") + F.col(f"{y}.n")))


def _open(spark: SparkSession, members: DataFrame, nodes: DataFrame, comp: DataFrame) -> DataFrame:
    """(node, sig, comp, n, sk) of the buckets that span several components; written."""
    part = keep(spark, members.select("sig", "node").join(comp, "node", "left").select("sig", "node", F.coalesce("comp", "node").alias("comp")), "join-part")
    open_ = part.groupBy("sig").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("sig")
    side = keep(spark, part.join(open_, "sig").join(nodes.select("node", "n", "sk"), "node"), "join-side")
    drop(part)
    return side


def _starred(spark: SparkSession, side: DataFrame, percent: int, seed: int) -> DataFrame | None:
    """(a, b): each wide bucket's member with the least hash, and its members of other components; written.  None without wide buckets."""
    centres = side.groupBy("sig").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(F.xxhash64("node", F.lit(seed)).alias("h"), "node", "comp", "n", "sk")).alias("x"))
    centres = keep(spark, centres.where(F.col("c") > WIDE).select("sig", "x.node", "x.comp", "x.n", "x.sk"), "join-centres")
    pairs = None
    if centres.limit(1).count():
        met = sized(centres).alias("x").join(side.alias("y"), (F.col("x.sig") == F.col("y.sig")) & (F.col("x.comp") != F.col("y.comp")) & _near("x", "y", percent))
        pairs = keep(spark, met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct(), "join-starred")
    drop(centres)
    return pairs


def _crossing(side: DataFrame, percent: int) -> DataFrame:
    """(a, b) of different components in one bucket.  A pair that shares one of the LAST signatures before this bucket's has met
    there; the least signature that both have always makes it, so none is lost and few come twice."""
    earlier = F.collect_list("sig").over(Window.partitionBy("node").orderBy("sig").rowsBetween(-LAST, -1))
    side = side.withColumn("earlier", earlier)
    x, y = side.alias("x"), side.alias("y")
    apart = (F.col("x.sig") == F.col("y.sig")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.comp") != F.col("y.comp"))
    return x.join(y, apart & _near("x", "y", percent) & ~F.arrays_overlap("x.earlier", "y.earlier")).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def jaccard_components(spark: SparkSession, docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs(doc_id, text, ...)."""
    docs = docs.select("doc_id", "text")
    screened = percent < SCREENED_BELOW
    feats = keep(spark, _features(docs, n, (lambda s: _sample(s, percent)) if screened else (lambda s: signatures(s, percent))), "join-feats")
    ids = keep(spark, feats.select("doc_id", "n", "node"), "join-ids")
    one = [F.min("doc_id").alias("root"), F.first("n").alias("n"), F.first("sk").alias("sk"), F.first(F.size("sigs")).alias("p")]
    nodes = keep(spark, feats.where("node IS NOT NULL").groupBy("node").agg(*one), "join-nodes")
    copies = _copies(spark, ids, nodes)
    pages, maybe = possible(spark, copies, "key__")
    rows = _originals(feats, copies, maybe)
    if screened:
        rows = _linkable(spark, docs, nodes, rows, n, percent)
        drop(feats)
        feats = rows
    seen = _shared(spark, rows)
    drop(feats)
    least = seen.groupBy("sig").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("sig", "lo")
    members = keep(spark, seen.join(least, "sig").select("sig", "lo", "node"), "join-members")
    drop(copies, pages, seen)
    stars = members.where("node <> lo").select("lo", "node").distinct()
    info = lambda name: nodes.select(F.col("node").alias(name), "n", "sk").alias(name)
    first = stars.join(info("a"), F.col("lo") == F.col("a.a")).join(info("b"), F.col("node") == F.col("b.b")).where(_near("a", "b", percent)).select(F.col("a.a"), F.col("b.b"))
    first = keep(spark, first, "join-first")
    links = _verified(spark, docs, nodes, first, n, percent)
    comp = components(spark, reduce(DataFrame.unionAll, links))
    drop(first)

    side, seed = _open(spark, members, nodes, comp), 0
    while seed < STARS and (pairs := _starred(spark, side, percent, seed)) is not None:
        found = _verified(spark, docs, nodes, pairs, n, percent)
        drop(pairs)
        links, seed = links + found, seed + 1
        if not any(part.limit(1).count() for part in found):
            break
        drop(side, comp)
        comp = components(spark, reduce(DataFrame.unionAll, links))
        side = _open(spark, members, nodes, comp)
    drop(members, comp)
    second = keep(spark, _crossing(side, percent).distinct(), "join-second")
    drop(side)
    links += _verified(spark, docs, nodes, second, n, percent)
    comp = components(spark, reduce(DataFrame.unionAll, links))

    rooted = keep(spark, nodes.select("node", "root").join(comp, "node", "left").select("node", "root", F.coalesce("comp", "node").alias("comp")), "join-rooted")
    drop(*links, second, nodes, comp)
    least = rooted.groupBy("comp").agg(F.min("root").alias("component_id"))
    labels = rooted.select("node", "comp").join(least, "comp").select(F.col("node").alias("of_node"), "component_id")
    out = ids.join(labels, F.col("node") == F.col("of_node"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(spark: SparkSession, docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id.

    Of rows that repeat a doc_id the one with the least text stays; rows without doc_id stay as they are.
    """
    whole = docs.select(docs["doc_id"].alias("id__"), F.struct(*[docs[c] for c in docs.columns]).alias("row__"))
    counts = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c"))
    odd = counts.agg(F.max(F.when(F.col("doc_id").isNotNull(), F.col("c"))).alias("most"), F.max(F.col("doc_id").isNull().cast("int")).alias("nulls")).first()
    unnamed = whole.where("id__ IS NULL")
    if odd["nulls"]:
        whole = whole.where("id__ IS NOT NULL")
    if (odd["most"] or 0) > 1:
        whole = keep(spark, whole.groupBy("id__").agg(F.min_by("row__", F.struct(F.col("row__.text"), F.xxhash64("row__"))).alias("row__")), "join-once")
    found = jaccard_components(spark, whole.select(F.col("id__").alias("doc_id"), F.col("row__.text").alias("text")), n, percent)
    gone = keep(spark, found.where("n_shingles > 0 AND component_id <> doc_id").select(F.col("doc_id").alias("gone__")).distinct(), "join-gone")
    kept = whole.join(sized(gone), whole["id__"] == gone["gone__"], "left_anti")
    kept = kept.unionByName(unnamed) if odd["nulls"] else kept
    return kept.select("row__.*")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark, table(spark, sf_dir, "documents"), OP4_N, OP4_PERCENT)


def join_sql(docs: str = "documents", n: int = N, percent: int = PERCENT) -> str:
    """CTEs (WITH RECURSIVE) that end in `linked(doc_id, n_shingles, component_id)`."""
    window = " || ' ' || ".join(["w[i]", *[f"w[i+{k}]" for k in range(1, n)]])
    return rf"""
jt AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {docs}),
js AS (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, {window} AS g FROM (SELECT doc_id, w, unnest(range(1, len(w)-{n - 2})) AS i FROM jt WHERE len(w) >= {n})
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM jt WHERE len(w) BETWEEN 1 AND {n - 1})),
jz AS (SELECT doc_id, count(*) AS n FROM js GROUP BY doc_id),
jsh AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM js a JOIN jz za ON za.doc_id = a.doc_id JOIN js b ON a.g = b.g AND a.doc_id < b.doc_id JOIN jz zb ON zb.doc_id = b.doc_id
  AND 100 * least(za.n, zb.n) >= {percent} * greatest(za.n, zb.n) GROUP BY 1, 2),
je AS (SELECT a, b FROM jsh JOIN jz za ON za.doc_id = a JOIN jz zb ON zb.doc_id = b WHERE 100 * i >= {percent} * (za.n + zb.n - i)),
je2 AS (SELECT a, b FROM je UNION SELECT b, a FROM je),
jr(x, y) AS (SELECT doc_id, doc_id FROM jt UNION SELECT jr.x, je2.b FROM jr JOIN je2 ON jr.y = je2.a),
linked AS (SELECT jt.doc_id, coalesce(jz.n, 0) AS n_shingles, c.component_id FROM jt LEFT JOIN jz ON jz.doc_id = jt.doc_id JOIN (SELECT x, min(y) AS component_id FROM jr GROUP BY x) c ON c.x = jt.doc_id)"""


OP4_SQL = f"WITH RECURSIVE {join_sql("documents", OP4_N, OP4_PERCENT).strip()} SELECT doc_id, n_shingles, component_id FROM linked"
