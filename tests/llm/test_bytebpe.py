import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F

from tidewatch.llm import bytebpe, queries

PATH, PATTERN = public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return bytebpe.library(PATH, PATTERN)


@pytest.fixture(scope="module")
def ranks():
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}


def plain(ranks, text):
    """Byte-pair merging as defined: of each match, the pair of least rank first, the leftmost of equals."""
    out = []
    for match in regex.findall(PATTERN, text):
        parts = [bytes([x]) for x in match.encode()]
        while len(parts) > 1:
            rank, at = min((ranks.get(parts[i] + parts[i + 1], 10**9), i) for i in range(len(parts) - 1))
            if rank == 10**9:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        out += [ranks[p] for p in parts]
    return out


TEXTS = ["", " ", "\n \n", "it's we'll I'd 'tis", "x  y\n\n z\t", "naïve Ελλάδα русский текст 123 ١٢٣", "漢字かな交じり。文", "👩‍👩‍👧 é    x", "<|endoftext|>", "don't!!!  ???'s", "a" * 300, "\x00\x1f\x85"]


def test_ids_are_the_merges_of_the_ranks(docs, ranks):
    got = {r.doc_id: r for r in bytebpe.decode(bytebpe.encode(docs(enumerate(TEXTS)), PATH, PATTERN), PATH, PATTERN).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i].ids == plain(ranks, t)
        assert bytes(got[i].decoded) == t.encode()


def test_parts_do_not_change_ids(library):
    rng = random.Random(5)
    bits = ["word", "Ünï", "ελ", "я", "漢字", "12", "²", "'", "'s", "'ll", " ", "  ", "\n", "\r\n", " ", "　", ".", "。", "!?", "_", "👍", "é", "͸"]
    for _ in range(400):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 120)))
        for size in (1, 7, 30):
            assert "".join(bytebpe.parts(text, size)) == text
            assert bytebpe.encode_text(library, text, size).tolist() == library.encode_ordinary(text), text


@pytest.mark.parametrize("text", ["a" * 150_000, " " * 150_000 + "x", "漢" * 150_000, "!" * 150_000, "lorem ipsum dolor " * 20_000])
def test_long_texts(library, text):
    ids = bytebpe.encode_text(library, text)
    assert library.decode_bytes(ids.tolist()) == text.encode()
    assert np.array_equal(ids, library.encode_ordinary(text))


def test_parts_are_bounded_where_words_are():
    assert max(map(len, bytebpe.parts("lorem ipsum dolor " * 20_000))) < bytebpe.PART + 20


def test_null_text_repeats_extra_columns_and_no_rows(docs):
    df = docs([(1, None), (None, "a b"), (2, "x"), (2, "x")]).withColumn("ids", F.lit("i")).withColumn("decoded", F.lit(1))
    out = bytebpe.decode(bytebpe.encode(df, PATH, PATTERN), PATH, PATTERN).collect()
    assert sorted(((r.doc_id, bytes(r.decoded)) for r in out), key=str) == sorted([(1, b""), (None, b"a b"), (2, b"x"), (2, b"x")], key=str)
    assert bytebpe.encode(docs([]), PATH, PATTERN).count() == 0


def test_decoding_is_by_raw_bytes(spark, library):
    ids = library.encode_ordinary("👍")
    assert len(ids) > 1
    out = bytebpe.decode(spark.createDataFrame([(1, ids[:1]), (2, None)], "doc_id long, ids array<int>"), PATH, PATTERN).collect()
    assert {r.doc_id: bytes(r.decoded) for r in out} == {1: library.decode_single_token_bytes(ids[0]), 2: b""}


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.op12_bytebpe(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode_ordinary(r.text or "")
        sha = lambda b: hashlib.sha256(b).hexdigest()
        assert tuple(got[r.doc_id]) == (r.doc_id, len(ids), sha(",".join(map(str, ids)).encode()), sha((r.text or "").encode()))
