"""TF-IDF of documents by blocks against the plain vectors."""

import random
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from tidewatch.functions.numfmt import rnd
from tidewatch.operators.matching import tfidf_vectors
from tidewatch.operators.textsim import _pack, _pack_counts, _unpack, _unpack_counts, document_tfidf_summary
from tidewatch.session import checkpoint_dir

ROWS = [(1, "The quick brown fox; the quick dog"), (2, "brown fox x brown fox"), (3, None), (4, ""), (5, "the of and"), (6, "a b c"),
        (7, "Été, été-naïve 12_3 ab a12 ab"), (2, "fox brown again"), (None, "nobody owns this text"), (None, "nobody owns that"),
        (8, "aa aab aa aab aa"), (9, " ".join(f"w{i % 37}" for i in range(200))), (1, "quick dog")]


def test_blocks_give_the_plain_vectors(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    vec = tfidf_vectors(docs, None, "doc_id", "text")
    plain = vec.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"), F.min_by("term", F.struct(-rnd(F.col("w"), 9), F.col("term"))).alias("top_term"),
                                      F.max(rnd(F.col("w"), 6)).alias("top_weight")).collect()
    assert len(plain) == 6
    for size in (1, 7, 1 << 20):                       # a block per document, a few, one
        got = document_tfidf_summary(docs, block_tokens=size)
        assert "regexp" not in got._jdf.queryExecution().optimizedPlan().toString()    # texts are read into terms once
        assert sorted(map(str, got.collect())) == sorted(map(str, plain))


def test_no_text_at_all(spark):
    docs = spark.createDataFrame([(1, None), (2, "the")], "doc_id long, text string")
    assert document_tfidf_summary(docs).collect() == []


def shuffled(plan):
    """Bytes written by the exchanges of a plan that has run; a reused one counts once."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return shuffled(plan.executedPlan())
    if name.endswith("QueryStage"):
        return shuffled(plan.plan())
    if name == "ReusedExchange":
        return 0
    own = plan.metrics().apply("shuffleBytesWritten").value() if name == "Exchange" else 0
    return own + sum(shuffled(plan.children().apply(k)) for k in range(plan.children().size()))


def test_less_is_written_and_shuffled_than_three_times_the_texts(spark):
    r = random.Random(3)
    words = ["".join(r.choices("abcdefghijklmnop", k=r.randint(4, 9))) for _ in range(20000)]
    rows = [(k, " ".join(r.choices(words, k=400))) for k in range(400)]        # nearly all pairs occur once
    at = checkpoint_dir(spark).split(":", 1)[-1]
    there = set(Path(at).glob("tfidf-*"))
    got = document_tfidf_summary(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), block_tokens=1 << 14)
    assert got.where("n_terms > 700").count() == 400
    assert len(got.collect()) == 400
    written = sum(f.stat().st_size for d in set(Path(at).glob("tfidf-*")) - there for f in d.glob("*.parquet"))
    moved = shuffled(got._jdf.queryExecution().executedPlan())
    assert 0 < written and 0 < moved and written + moved < 3 * sum(len(t) for _, t in rows)


def test_many_documents_in_a_block(spark):
    docs = spark.range(50_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id")).alias("text"))
    got = document_tfidf_summary(docs)              # documents times terms are more than 32 bits hold
    assert got.where((F.col("n_terms") == 1) & (F.col("top_weight") == 1) & (F.col("top_term") == F.concat(F.lit("w"), F.col("doc_id")))).count() == 50_000
    assert got.count() == 50_000


def test_packed():
    for x in (b"", b"abc", b"word " * 1000, bytes(range(256)) * 9):
        assert _unpack(_pack(x)) == x
    for n in ([], [1], list(range(0, 70000, 7)), [1 << 40, 1, 255, 256]):
        assert _unpack_counts(_pack_counts(np.array(n, np.int64))).tolist() == n
