"""The registered query of each operator, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, bytebpe, coder, langid, licenses, minhash, packing, quality, runs, secrets, substrings, topk, whitening
from .common import SPACE, read_table

#: The tokenizer file of the token operators.
TOKENIZER = "word_bpe_49k.json"
#: The rank file of the byte-level operator.
RANKS = "byte_bpe_multi_50k.tiktoken"


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents")


def op1_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.judge(_documents(spark, sf))


def op2_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode_digests(_documents(spark, sf), public_tokenizers.path(TOKENIZER))


def op3_coder(spark: SparkSession, sf: str) -> DataFrame:
    return coder.read(coder.write(_documents(spark, sf), public_tokenizers.path(TOKENIZER)))


def op4_langid(spark: SparkSession, sf: str) -> DataFrame:
    return langid.identify(_documents(spark, sf))


def op5_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.classes(_documents(spark, sf))


def op6_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(_documents(spark, sf), public_tokenizers.path(TOKENIZER))


def op7_topk(spark: SparkSession, sf: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf, "embeddings"), "vec_id % 50 = 0")


def op8_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.scan(_documents(spark, sf))


def op9_licenses(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan(_documents(spark, sf))


def op10_substrings(spark: SparkSession, sf: str) -> DataFrame:
    return substrings.passages(_documents(spark, sf))


def op11_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


def op12_bytebpe(spark: SparkSession, sf: str) -> DataFrame:
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    tokens = bytebpe.decode(bytebpe.encode(_documents(spark, sf), path, pattern), path, pattern)
    decimals = F.array_join(F.col("ids").cast("array<string>"), ",")
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimals, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def periodic_tails(docs: DataFrame) -> DataFrame:
    """doc_id, text, where a tenth of the ids (by checksum) get a text whose words repeat from some word on.

    With h the crc32 of the decimal id and g = h div 10, texts of n > 0 words
    with h % 10 = 0 go on from word a = g % n with period
    p = 1 + (n - a) div (3 + g % 8). Null ids keep their text.
    """
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    split = F.filter(F.split("text", SPACE), lambda w: w != "")
    cut = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, split).alias("words"))
    placed = cut.withColumn("n", F.when(F.size("words") > 0, F.size("words"))).withColumn("a", (F.col("g") % F.col("n")).cast("int"))
    period = placed.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    repeated = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", F.col("a") + (i - F.col("a")) % F.col("p"))))
    return period.select("doc_id", F.when(F.col("n").isNotNull(), F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """Per document the number of its runs, the one of greatest length / period, and digests."""
    order = """case when a.length * b.period <> b.length * a.period then if(a.length * b.period > b.length * a.period, -1, 1)
               when a.start <> b.start then if(a.start < b.start, -1, 1) else cast(sign(a.period - b.period) as int) end"""
    best = found.withColumn("best", F.expr(f"get(array_sort(runs, (a, b) -> {order}), 0)"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_runs(spark: SparkSession, sf: str) -> DataFrame:
    return run_digests(runs.find_runs(periodic_tails(_documents(spark, sf))))


#: name -> (query, SQL or None)
REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_quality": (op1_quality, quality.SQL),
    "op2_bpe": (op2_bpe, None),
    "op3_coder": (op3_coder, None),
    "op4_langid": (op4_langid, None),
    "op5_minhash": (op5_minhash, None),
    "op6_packing": (op6_packing, None),
    "op7_topk": (op7_topk, topk.SQL),
    "op8_secrets": (op8_secrets, None),
    "op9_licenses": (op9_licenses, None),
    "op10_substrings": (op10_substrings, None),
    "op11_whitening": (op11_whitening, None),
    "op12_bytebpe": (op12_bytebpe, None),
    "op13_runs": (op13_runs, None),
}
