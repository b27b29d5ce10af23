"""Text and embedding similarity over large tables (M-1, M-2, M-3, M-6 at scale).

* :func:`document_tfidf_summary` - the matcher's TF-IDF applied to a whole text
  table (every word of every document), summarised per document.
* :func:`embed` and :func:`cosine_similarity` - an embedding model, or vectors from
  a table, as the similarity of the column matcher (``match_scores(similarity=...)``).
* :func:`embedding_concept_match` - the embedding form of matching: every vector
  against a small set of concept vectors (here the per-label centroids derived
  from the table itself), cosine, softmax at temperature 0.1, best concept.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numfmt import rnd
from ..functions.stopwords import ENGLISH
from ..session import checkpoint_dir
from .matching import EMBEDDING_TEMPERATURE, TOKEN
from .ontology import CONCEPTS


BETWEEN = r"[^\p{L}\p{N}_]+"     # what parts words; a TOKEN is a word of two characters or more
BLOCK_TOKENS = 1 << 20     # words of a block of whole documents, on average; affects speed only
_PLAIN = 512               # shorter bytes are left to Spark's codecs, which see many rows at once
_ROWS = 1024               # texts cut at once


def _pack(x: bytes) -> bytes:
    return b"\0" + x if len(x) < _PLAIN else b"\1" + len(x).to_bytes(8, "little") + pa.compress(x, codec="zstd", asbytes=True)


def _unpack(x: bytes) -> bytes:
    return x[1:] if x[0] == 0 else pa.decompress(x[9:], int.from_bytes(x[1:9], "little"), codec="zstd", asbytes=True)


def _pack_counts(n: np.ndarray) -> bytes:
    return _pack(n.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes())       # mostly small: lowest bytes first, then zeros


def _unpack_counts(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_unpack(x), np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _tokens(schema: pa.Schema):
    """Arrow batches ``doc, words`` (parted by blanks) -> per row its tokens in order, packed, and their number; rows
    without any are left out."""
    stop = pa.array(ENGLISH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(k, _ROWS) for x in batches for k in range(0, x.num_rows, _ROWS)):
            tok = pc.split_pattern(b.column("words"), " ")
            flat = tok.flatten()
            kept = pc.and_not(pc.greater_equal(pc.utf8_length(flat), 2), pc.is_in(flat, stop))
            ends = np.append(0, np.cumsum(kept.to_numpy(zero_copy_only=False)))[np.append(0, np.cumsum(pc.list_value_length(tok).to_numpy()))]
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat.filter(kept)), " ")
            n = np.diff(ends)
            some = pa.array(np.flatnonzero(n))
            packed = pa.array([_pack(x) for x in text.take(some).cast(pa.binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc").take(some), packed, pa.array(n).take(some)], schema=schema)

    return run


def _terms(docs: pa.Table):
    """The documents of a block -> ``doc, words, one, two, of, term, tf``.

    ``words`` are its distinct words in order of their bytes; ``one, two`` its distinct terms as a word's number and
    the next word's number plus 1 (0: none), in order of their text, as a space sorts before every character of a
    token. ``of, term, tf`` are the terms of every document, by document and term.
    """
    import pandas as pd

    tok = pc.split_pattern(pa.array([_unpack(x).decode() for x in docs.column("words").to_pylist()], pa.string()), " ")
    doc = docs.column("doc").combine_chunks()
    nth = doc.dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)      # rows of a document need not be side by side
    row = np.repeat(np.arange(len(tok)), pc.list_value_length(tok).to_numpy())
    found = tok.flatten().dictionary_encode()
    order = pc.sort_indices(found.dictionary).to_numpy()
    words, v = found.dictionary.take(pa.array(order)), len(order)
    rank = np.empty(v, np.int64)
    rank[order] = np.arange(v)
    codes = rank[found.indices.to_numpy()]
    beside = row[:-1] == row[1:]
    keys = np.concatenate([codes * (v + 1), codes[:-1][beside] * (v + 1) + codes[1:][beside] + 1])
    which, terms = pd.factorize(keys)
    order = np.argsort(terms)
    place = np.empty(len(terms), np.int64)
    place[order] = np.arange(len(terms))
    pairs, tf = np.unique(np.concatenate([nth[row], nth[row[:-1][beside]]]) * len(terms) + place[which], return_counts=True)
    ids = doc.take(pa.array(np.unique(nth, return_index=True)[1]))
    return ids, words, terms[order] // (v + 1), terms[order] % (v + 1), pairs // len(terms), pairs % len(terms), tf


def _text(words: pa.Array, one: np.ndarray, two: np.ndarray) -> pa.Array:
    first, second = words.take(pa.array(one)), words.take(pa.array(np.maximum(two - 1, 0)))
    return pc.if_else(pa.array(two == 0), first, pc.binary_join_element_wise(first, second, " "))


def _dealt(words: pa.Array, one: np.ndarray, two: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The terms dealt to ``parts`` by a hash of their words: their order by part, then text, and where each part begins."""
    import pandas as pd

    h = pd.util.hash_array(np.array(words.to_pylist(), object))
    key = h[one] * np.uint64(0x9E3779B97F4A7C15) + np.append(np.uint64(0), h)[two]
    key = (key ^ (key >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    part = ((key ^ (key >> np.uint64(32))) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def _shares(schema: pa.Schema, parts: int):
    """The documents of a block -> a row per part: the block's terms in it, and in how many documents each is."""

    def run(docs: pa.Table) -> pa.Table:
        _, words, one, two, _, term, _ = _terms(docs)
        order, begin = _dealt(words, one, two, parts)
        some = np.flatnonzero(np.diff(begin))
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array(begin, pa.int32()), _text(words, one[order], two[order])), "\n")
        df = np.split(np.bincount(term, minlength=len(one))[order], begin[1:-1])
        found = {"part": pa.array(some), "block": pa.array([docs.column("block")[0].as_py()] * len(some)),
                 "terms": [_pack(x) for x in text.take(pa.array(some)).cast(pa.binary()).to_pylist()], "df": [_pack_counts(df[k]) for k in some]}
        return pa.table([found[f.name] if isinstance(found[f.name], pa.Array) else pa.array(found[f.name], f.type) for f in schema], schema=schema)

    return run


def _sums(schema: pa.Schema):
    """The shares of all blocks in a part -> for each share the number of documents over all blocks, in order of its terms."""

    def run(shares: pa.Table) -> pa.Table:
        texts = [_unpack(x) for x in shares.column("terms").to_pylist()]
        ends = np.cumsum([x.count(b"\n") + 1 for x in texts])
        terms = pc.split_pattern(pa.array([b"\n".join(texts)], pa.large_binary()), "\n").flatten()
        of = terms.dictionary_encode().indices.to_numpy()
        df = np.concatenate([_unpack_counts(x) for x in shares.column("df").to_pylist()])
        total = np.split(np.bincount(of, df)[of].astype(np.int64), ends[:-1])
        return pa.table([shares.column("block"), shares.column("part"), pa.array([_pack_counts(x) for x in total], pa.binary())], schema=schema)

    return run


def _tops(schema: pa.Schema, parts: int, n: int):
    """The documents of a block and the counts of its shares, among ``n`` documents -> per document the number of
    terms and the largest weights: per weight within 2e-9 of the largest, the smallest of its terms."""

    def run(docs: pa.Table, sums: pa.Table) -> pa.Table:
        ids, words, one, two, of, term, tf = _terms(docs)
        df = np.empty(len(one), np.int64)
        df[_dealt(words, one, two, parts)[0]] = np.concatenate([_unpack_counts(x) for x in sums.sort_by("part").column("df").to_pylist()])
        size = np.bincount(of)
        first = np.cumsum(size) - size
        w = tf * (np.log((n + 1) / (df + 1)) + 1)[term]
        x = w / np.sqrt(np.add.reduceat(w * w, first))[of]
        near = np.flatnonzero(x >= np.maximum.reduceat(x, first)[of] - 2e-9)
        near = near[np.lexsort((term[near], x[near], of[near]))]
        fresh = np.diff(of[near], prepend=-1) != 0
        fresh[1:] |= np.diff(x[near]) != 0
        near = near[fresh]
        offsets = pa.array(np.append(np.searchsorted(of[near], np.arange(len(size))), len(near)), pa.int32())
        tops = pa.StructArray.from_arrays([pa.array(x[near]), _text(words, one[term[near]], two[term[near]])], ["w", "term"])
        found = {"doc": ids, "n_terms": pa.array(size), "tops": pa.ListArray.from_arrays(offsets, tops)}
        return pa.table([found[f.name].cast(f.type) for f in schema], schema=schema)

    return run


def document_tfidf_summary(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text",
                           block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Per document: number of distinct terms and the heaviest term (ties: smaller term).

    The vectors of :func:`tfidf_vectors`, a block of documents at a time. Texts are read into tokens once, written
    packed, and dealt to blocks by a hash of their document, so that all its rows meet in one. Of a block's distinct
    terms a packed share goes to each part of all terms and comes back as numbers of documents alone; the block
    then counts its terms again. A part holds the terms of about two blocks, whatever their number.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    kind = T.StructField("doc", docs.schema[doc_col].dataType)
    form = lambda ddl: T.StructType([f if f.name != "doc" else kind for f in T._parse_datatype_string(ddl.format(doc="doc int")).fields])
    n = docs.agg(F.countDistinct(doc_col)).first()[0]
    rows = docs.where(F.col(text_col).isNotNull()).select(
        F.col(doc_col).alias("doc"), F.regexp_replace(F.lower(F.col(text_col)), BETWEEN, " ").alias("words"))
    schema = form("{doc}, words binary, n long")
    at = f"{checkpoint_dir(spark).rstrip('/')}/tfidf-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    rows.mapInArrow(_tokens(to_arrow_schema(schema)), schema).write.parquet(at)
    tokens = spark.read.schema(schema).parquet(at)
    number = max(1, -(-(tokens.agg(F.sum("n")).first()[0] or 0) // block_tokens))
    parts = max(1, -(-number // 2))
    blocks = tokens.select(F.pmod(F.xxhash64("doc"), F.lit(number)).alias("block"), "doc", "words").groupBy("block")
    share = form("part long, block long, terms binary, df binary")
    back = form("block long, part long, df binary")
    out = form("{doc}, n_terms long, tops array<struct<w: double, term: string>>")
    shares = blocks.applyInArrow(_shares(to_arrow_schema(share), parts), share)
    sums = shares.groupBy("part").applyInArrow(_sums(to_arrow_schema(back)), back)
    best = blocks.cogroup(sums.groupBy("block")).applyInArrow(_tops(to_arrow_schema(out), parts, n), out)
    top = F.array_max(F.transform("tops", lambda s: rnd(s["w"], 9)))
    return best.withColumn("top", top).select(
        F.col("doc").alias(doc_col), "n_terms",
        F.array_min(F.transform(F.filter("tops", lambda s: rnd(s["w"], 9) == F.col("top")), lambda s: s["term"])).alias("top_term"),
        rnd(F.array_max(F.transform("tops", lambda s: s["w"])), 6).alias("top_weight"))


def embed(texts: DataFrame, text_col: str, make_model: Callable[[], Callable], batch_size: int = 256) -> DataFrame:
    """``texts`` with a column ``vector array<double>`` by an embedding model.

    ``make_model`` loads the model once per Python worker and returns a function from an array of
    texts to an (n, dimensions) array; texts reach it in Arrow batches.
    """
    from pyspark.ml.functions import predict_batch_udf

    model = predict_batch_udf(make_model, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size)
    return texts.withColumn("vector", model(F.coalesce(F.col(text_col), F.lit(""))))


def cosine_similarity(columns: DataFrame, concepts: DataFrame) -> DataFrame:
    """``dataset_id, column_name, concept, sim``: each column's vector against each concept's.

    Takes ``dataset_id, column_name, vector`` and ``concept, vector``. The concepts are one broadcast
    row (at most ``MOST_CONCEPTS``, else an error); a column's cosines are computed in its row. A null
    or zero vector, or one of another length, is similar to nothing (0).
    """
    double = lambda c: F.transform(c, lambda x: x.cast("double"))
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    known = concepts.select("concept", double("vector").alias("v")).withColumn("n", length(F.col("v")))
    one = known.agg(F.collect_list(F.struct("concept", "v", "n")).alias("concepts")).withColumn(
        "concepts", F.when(F.size("concepts") <= MOST_CONCEPTS, F.col("concepts")).otherwise(F.raise_error(F.lit(f"more than {MOST_CONCEPTS} concepts"))))
    rows = columns.select("dataset_id", "column_name", double("vector").alias("v")).withColumn("n", length(F.col("v")))
    pairs = rows.join(F.broadcast(one)).select("dataset_id", "column_name", "v", "n", F.explode("concepts").alias("k"))
    dot = F.aggregate(F.zip_with("v", F.col("k.v"), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    scale = F.col("n") * F.col("k.n")
    return pairs.select("dataset_id", "column_name", F.col("k.concept").alias("concept"), F.coalesce(F.when(scale > 0, dot / scale), F.lit(0.0)).alias("sim"))


def embedding_similarity(profiles: DataFrame, make_model: Callable[[], Callable]) -> DataFrame:
    """M-2: the similarity of profiled columns to the concepts by an embedding model over their texts.

    For ``map_columns(profiles, temperature=EMBEDDING_TEMPERATURE, similarity=...)``.
    """
    concepts = profiles.sparkSession.createDataFrame([(k, t) for k, _, _, t in CONCEPTS], "concept string, text string")
    return cosine_similarity(embed(profiles, "descriptor", make_model), embed(concepts, "text", make_model))


MOST_CONCEPTS = 10_000     # concepts are a small fixed set; their vectors travel with every task


def embedding_concept_match(emb: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                            label_col: str = "label", temperature: float = EMBEDDING_TEMPERATURE) -> DataFrame:
    """``id, best_label, cosine, confidence`` of every vector against the label centroids.

    The centroids (at most ``MOST_CONCEPTS``, else an error) are one broadcast row; a vector's dot
    products, softmax and best label are computed in its row, so only the centroids are shuffled.
    """
    cells = emb.where(F.col(label_col).isNotNull()).select(F.col(label_col).alias("label"), F.posexplode(vec_col).alias("i", "x"))
    cent = cells.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("c"))
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    one = cent.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda s: s["c"]).alias("c"))
    one = one.agg(F.array_sort(F.collect_list(F.struct("label", "c", length(F.col("c")).alias("norm")))).alias("concepts"))
    concepts = one.withColumn("concepts", F.when(F.size("concepts") <= MOST_CONCEPTS, F.col("concepts"))
                              .otherwise(F.raise_error(F.lit(f"more than {MOST_CONCEPTS} labels"))))
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    rows = emb.select(id_col, v.alias("v")).withColumn("vn", length(F.col("v"))).join(F.broadcast(concepts))
    dot = lambda k: F.aggregate(F.zip_with("v", k["c"], lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    rows = rows.withColumn("cos", F.transform("concepts", lambda k: F.struct(
        rnd(dot(k) / (F.col("vn") * k["norm"]), 9).alias("cos"), k["label"].alias("label"))))
    top = F.array_max(F.transform("cos", lambda c: c["cos"]))
    rows = rows.select(id_col, "cos", top.alias("top"))
    total = F.aggregate("cos", F.lit(0.0), lambda a, c: a + F.exp((c["cos"] - F.col("top")) / F.lit(temperature)))
    best = F.array_min(F.transform(F.filter("cos", lambda c: c["cos"] == F.col("top")), lambda c: c["label"]))
    return rows.select(id_col, best.alias("best_label"), rnd(F.col("top"), 6).alias("cosine"),
                       rnd(F.lit(1.0) / total, 4).alias("confidence"))
