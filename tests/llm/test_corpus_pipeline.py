"""Each stage on its own input, the whole against its stages, and the SQL of the queries."""

import corpus_pipeline
import duckdb
import pytest

from tidewatch.llm import minhash, quality
from tidewatch.llm.common import words_of
from tidewatch.llm.queries import REGISTRY

SF = "/root/testdata/sf0.001"


def test_stages(docs, words):
    p, token = words(60), "token = abcdef0123456789"
    rows = [(1, f"{words(60)} {p}"), (2, words(3)), (3, f"{words(60)} {token}"), (4, f"{p} {words(70)}"), (6, None), (7, "")]
    rows += [(5, rows[0][1]), (5, rows[0][1])]
    df, kept = docs(rows), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(df.sparkSession, df, None)
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = sorted(r.doc_id for r in df.collect())
    assert kept["quality_rules"] == [1, 3, 4, 5, 5] and kept["near_dedup"] == kept["secret_scan"] == [1, 3, 4]
    text = {r.doc_id: r.text for r in df.collect()}
    assert text[1] == rows[0][1] and p not in text[4] and "[secret]" in text[3]
    assert all(r.n_chars == len(r.text) for r in df.collect())
    out = corpus_pipeline.STAGES[-1][1](df.sparkSession, df, None).toPandas()
    assert set(out.doc_id) == {1, 3, 4}


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert (out.groupby("doc_id").length.sum() == out.groupby("doc_id").doc_tokens.first()).all()
    good = quality.keep(docs)
    assert set(out.doc_id) == {r.class_id for r in minhash.classes(good).collect()}


@pytest.mark.parametrize("name", [n for n, (_, sql) in REGISTRY.items() if sql])
def test_sql(spark, name):
    query, sql = REGISTRY[name]
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = con.execute(sql).df()
    got = query(spark, SF).toPandas()[want.columns.tolist()]
    order = sorted(want.columns)
    assert sorted(map(tuple, got[order].values.tolist())) == sorted(map(tuple, want[order].values.tolist()))


def test_words_split_at_ascii_space_alone():
    assert words_of("a\x1cb\xa0c　d e\n\nf") == ["a\x1cb\xa0c　d", "e", "f"] and words_of(None) == []
