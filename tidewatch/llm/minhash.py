"""Near-duplicate classes by ProbMinHash of weighted shingles, banding and verification.

A document is its set of five-word shingles. A shingle's weight depends on its
words alone, however often it occurs in the document: the mean of their levels,
where the level of a word is eight times log2 of (words of all documents /
words of its bucket), rounded, and words fall into 65 536 buckets by hash. The
weight (1 to 255) is kept in the low byte of the shingle's hash. Two documents
are similar if the plain Jaccard similarity of their sets or the weighted one
is at least ``SIMILAR``: the first finds copies whatever their words, the second
also copies that differ in common phrases.

A shingle's hash drives a Poisson process of its weight as rate, whose
arrivals fall on random signature slots; a slot keeps the shingle that arrived
there first. The processes advance together and one ends when its next arrival
is later than every slot's (early termination). Slots of two documents agree
with their probability Jaccard similarity. As a shingle weighs the same in all
documents, that is the weighted Jaccard similarity, and for equal weights the
plain one; a document has a signature of each kind.

Equal word sequences are one node, found by a digest that is counted per task
first. Of the others, signatures are cut into bands; a bucket links its
members to a centre that is drawn anew per band, so a group of n near copies
asks for about n comparisons per band, not n squared. For members of a bucket
that are still in different components, a prefix join over their shingles
finds every pair that can be similar enough, so a link that no centre showed
isn't lost and dissimilar members make no pairs. Every pair is verified by the
exact similarities of its shingle sets; classes are the connected components.

Null texts and texts without a word are alone in their class; of 1 to 4 words,
all words make one shingle. A doc_id on several rows is one node. A null
doc_id has a null class. An empty table gives no rows; further columns of the
table play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shingles as S
from .common import cut, slices, to_arrow
from .components import components

BANDS, ROWS = 24, 4
SLOTS = BANDS * ROWS
SIMILAR = 0.8
WORD_BUCKETS = 1 << 16  # what the driver and every task hold of the words' counts
LEVELS = 8  # per doubling of rarity
HEAVIEST = 255

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], slots: int = SLOTS) -> np.ndarray:
    """A row of shingle hashes per (hashes, weights); zeros for an empty set."""
    out = np.zeros((len(sets), slots), np.uint64)
    sizes = np.array([len(h) for h, _ in sets])
    for i in np.flatnonzero(sizes == 1).tolist():
        out[i] = sets[i][0][0]  # the only element arrives first everywhere
    many = np.flatnonzero(sizes > 1)
    if not len(many):
        return out
    element = np.concatenate([sets[i][0] for i in many])
    rate = np.concatenate([sets[i][1] for i in many])
    row = np.repeat(np.arange(len(many)), sizes[many])
    arrival = np.zeros(len(element))
    least, first = np.full(len(many) * slots, np.inf), np.zeros(len(many) * slots, np.uint64)
    step = np.zeros(1, np.uint64)
    while len(element):
        step += _GOLD
        draw = S.mix(element + step)
        arrival = arrival - np.log(((draw >> np.uint64(11)).astype(float) + 1) * 2.0**-53) / rate
        at = row * slots + (S.mix(draw ^ _GOLD) % np.uint64(slots)).astype(np.int64)
        early = arrival < least[at]
        where, when, what = at[early], arrival[early], element[early]
        np.minimum.at(least, where, when)
        won = least[where] == when
        first[where[won]] = what[won]
        going = arrival < least.reshape(-1, slots).max(1)[row]
        element, rate, row, arrival = element[going], rate[going], row[going], arrival[going]
    out[many] = first.reshape(-1, slots)
    return out


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A bucket per band: the hash of its slots and its number."""
    n, slots = signature.shape
    cut_ = signature.reshape(n, slots // rows, rows)
    total = np.broadcast_to(np.arange(slots // rows, dtype=np.uint64) * _GOLD, cut_.shape[:2]).copy()
    for k in range(rows):
        total = S.mix(total + cut_[:, :, k])
    return total


COUNTS = pa.schema([("bucket", pa.int64()), ("n", pa.int64())])
SKETCH = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("digest", pa.binary()), ("n", pa.int64()), ("w", pa.int64()), ("buckets", pa.list_(pa.int64()))])
SETS = pa.schema([("node", pa.int64()), ("w", pa.int64()), ("shingles", pa.list_(pa.int64()))])


def bucket_of(words: np.ndarray) -> np.ndarray:
    """The bucket of each word hash."""
    return (words >> np.uint64(48)).astype(np.int64)


def word_levels(docs: DataFrame) -> np.ndarray:
    """The level of every bucket, from the words of all documents; at most ``WORD_BUCKETS`` rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(WORD_BUCKETS, np.int64)
        for b in slices(batches):
            if b.num_rows:
                n += np.bincount(bucket_of(np.concatenate([S.words(t) for t in b.column(0).to_pylist()])), minlength=WORD_BUCKETS)
        yield to_arrow(COUNTS, bucket=np.flatnonzero(n), n=n[n > 0])

    n = np.zeros(WORD_BUCKETS, np.int64)
    for bucket, count in docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        n[bucket] = count
    return np.rint(LEVELS * np.log2(max(n.sum(), 1) / np.maximum(n, 1))).astype(np.int64)  # (no document has a word of an empty bucket)


def weighted_shingles(words: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The sorted distinct shingles, each with its weight as its low byte."""
    if not len(words):
        return words
    width = min(len(words), S.WIDTH)
    upto = np.concatenate([[0], np.cumsum(levels[bucket_of(words)])])
    weight = np.clip((upto[width:] - upto[:-width]) // width, 1, HEAVIEST).astype(np.uint64)
    return np.unique(S.of_words(words) & ~np.uint64(255) | weight)


def weights(shingles: np.ndarray) -> np.ndarray:
    return (shingles & np.uint64(255)).astype(np.int64)


def sketch(docs: DataFrame, levels: np.ndarray) -> DataFrame:
    """doc_id, hash of the text, digest of the words (null: none), distinct shingles, their weight, buckets of both signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            words = [S.words(t) for t in b.column(1).to_pylist()]
            sets = [weighted_shingles(w, levels) for w in words]
            plain, heavy = signatures([(h, np.ones(len(h))) for h in sets]), signatures([(h, weights(h)) for h in sets])
            buckets = bands(np.concatenate([plain, heavy], 1)).view(np.int64)
            yield to_arrow(SKETCH, doc_id=b.column(0), text_hash=b.column(2), digest=[hashlib.blake2b(w.tobytes(), digest_size=16).digest() if len(w) else None for w in words], n=[len(h) for h in sets], w=[int(weights(h).sum()) for h in sets], buckets=list(buckets))

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text")).mapInArrow(run, "doc_id long, text_hash long, digest binary, n long, w long, buckets array<long>")


def shingle_sets(docs: DataFrame, levels: np.ndarray) -> DataFrame:
    """node, weight of its distinct shingles, these in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [weighted_shingles(S.words(t), levels) for t in b.column(1).to_pylist()]
            yield to_arrow(SETS, node=b.column(0), w=[int(weights(h).sum()) for h in sets], shingles=[h.view(np.int64) for h in sets])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "node long, w long, shingles array<long>")


def verified(pairs: DataFrame, sets: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, plain or weighted."""
    of = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s_{x}"), F.col("w").alias(f"w_{x}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    n = F.size("s_a").cast("long") + F.size("s_b")
    enough = lambda common, all_: common * 10000 >= (all_ - common) * round(similar * 10000)
    weight = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda sum_, s: sum_ + s.bitwiseAND(F.lit(255).cast("long")))
    alike = lambda c: enough(F.size(c).cast("long"), n) | enough(weight(c), F.col("w_a") + F.col("w_b"))
    return both.where(F.exists(F.array(F.array_intersect("s_a", "s_b")), alike)).select("a", "b")  # (an array of one, so that it is made once)


def across(apart: DataFrame, sets: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Pairs (a, b) of nodes with different labels that can be similar enough, by prefixes.

    A node's shingles are ordered by how many nodes have them; those that only one label has come
    first and can't be shared. The first shingle that two similar sets share has all others that they
    share after it: what a set holds from there on is at least t of the larger set and 2 t / (1 + t) of
    the smaller, and in both the overlap that they need. Sets are measured by number and by weight.
    Near copies that differ from each other in words of their own use up their prefix with these, so
    a group of them makes few pairs.
    """
    t = similar
    tokens = apart.join(sets, "node").select("node", "label", F.size("shingles").cast("long").alias("n"), "w", F.explode("shingles").alias("s"))
    seen = tokens.groupBy("s").agg(F.count(F.lit(1)).alias("df"), F.min("label").alias("x"), F.max("label").alias("y"))
    shared = tokens.join(seen.where("x <> y").select("s", "df"), "s")
    on = Window.partitionBy("node").orderBy(F.desc("df"), F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)  # the shingles of one document
    weight = F.col("s").bitwiseAND(F.lit(255).cast("long"))
    left = shared.withColumn("n_left", F.count(F.lit(1)).over(on)).withColumn("w_left", F.sum(weight).over(on))
    reach = lambda part, whole, share: F.col(part) >= F.col(whole) * share - 1e-6
    p = cut(left.where(reach("n_left", "n", t) | reach("w_left", "w", t)).drop("df"))

    def measured(by: str) -> DataFrame:
        side = lambda x: p.select("s", F.col("node").alias(x), F.col("label").alias(f"{x}_label"), F.col(by).alias(f"{x}_all"), F.col(f"{by}_left").alias(f"{x}_left"))
        large, small = side("a").where(reach("a_left", "a_all", t)), side("b").where(reach("b_left", "b_all", 2 * t / (1 + t)))
        smaller = (F.col("b_all") < F.col("a_all")) | ((F.col("b_all") == F.col("a_all")) & (F.col("b") < F.col("a")))
        enough = F.least("a_left", "b_left") >= (F.col("a_all") + F.col("b_all")) * (t / (1 + t)) - 1e-6
        both = large.join(small, "s").where((F.col("a_label") != F.col("b_label")) & smaller & reach("b_all", "a_all", t) & enough)
        return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    return measured("n").unionByName(measured("w")).distinct()


def classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id, class_id: the least doc_id of its class. One row per row of ``docs``."""
    return _labelled(docs, similar).select("doc_id", "class_id")


def _labelled(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id, hash of the text, class_id."""
    levels = word_levels(docs)
    known = cut(sketch(docs, levels))
    node = known.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "n", "w", "buckets")).alias("x"))
    nodes = cut(node.select("digest", F.col("x.doc_id").alias("node"), "x.n", "x.w", "x.buckets"))
    member = nodes.select("node", "n", "w", F.explode("buckets").alias("bucket"))
    # Buckets of several nodes, and a centre for each, drawn by a hash of both.
    centre = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct(F.xxhash64("node", "bucket").alias("r"), "node", "n", "w")).alias("c"))
    shared = cut(member.join(centre.where("size > 1").select("bucket", F.col("c.node").alias("centre"), F.col("c.n").alias("c_n"), F.col("c.w").alias("c_w")), "bucket"))
    alike = lambda x, y: F.least(x, y) * 10000 >= F.greatest(x, y) * round(similar * 10000)
    starred = shared.where((alike("n", "c_n") | alike("w", "c_w")) & (F.col("node") != F.col("centre")))
    pairs = cut(starred.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct())
    asked = shared.select("node").distinct()
    sets = cut(shingle_sets(docs.join(asked.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi"), levels))
    labels = components(verified(pairs, sets, similar))
    # Members of one bucket in different components: links that no centre showed.
    m = shared.select("bucket", "node").join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    open_ = m.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("bucket")
    apart = cut(m.join(open_, "bucket").select("node", "label").distinct())
    late = cut(across(apart, sets, similar).join(pairs, ["a", "b"], "left_anti"))
    if late.limit(1).count():
        found = cut(verified(late, sets, similar))
        if found.limit(1).count():
            labels = components(found, labels)
    named = known.select("doc_id", "text_hash", "digest").join(nodes.select("digest", "node"), "digest", "left")
    return named.join(labels, "node", "left").select("doc_id", "text_hash", F.coalesce("label", "node", "doc_id").alias("class_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each class, the one with the least doc_id; rows without a doc_id all stay.

    Of several texts under that doc_id, one whose own class it is stays.
    """
    first = _labelled(docs).where("doc_id = class_id").groupBy("doc_id").agg(F.min("text_hash").alias("text_hash"))
    first = first.select(F.col("doc_id").alias("_first"), F.col("text_hash").alias("_text_hash"))
    kept = docs.join(first, (docs["doc_id"] == first["_first"]) & (F.xxhash64(docs["text"]) == first["_text_hash"]), "left_semi")
    return kept.dropDuplicates(["doc_id"]).select(*docs.columns).unionByName(docs.where("doc_id is null"))
