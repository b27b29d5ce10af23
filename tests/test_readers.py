"""Readers: how a file is read is decided per file, and no record is lost."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tidewatch.sources.logs import read_csv_log, read_log


def put(path, body):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(body if isinstance(body, bytes) else body.encode())
    return path


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", ["l 1.csv", "l%201.csv", "l[1]{a}*.csv", "é 漢.csv"])
def test_latin_file_under_any_name(spark, scratch, name):
    p = put(f"{scratch}/a b/{name}", "kéy,v\n1,è\n2,x\n".encode("latin-1"))
    put(f"{scratch}/a b/m.csv", "kéy,v\n3,é�\n")
    df = read_log(spark, f"{scratch}/a b", "csv")
    assert df.columns == ["kéy", "v"] and rows(df) == [("1", "è"), ("2", "x"), ("3", "é�")]
    assert os.path.exists(p)


def test_quoted_line_breaks_only_where_a_file_has_them(spark, scratch):
    put(f"{scratch}/d/a.csv", 'a,b\n1,"x\ny"\n2,"he said ""no"", then\r\nleft"\n')
    put(f"{scratch}/d/b.csv", 'a,b\n3,"plain, ""q"""\n4,5" pipe\n')
    put(f"{scratch}/d/c.csv", "a,b\n" + "".join(f"{i},v\n" for i in range(10, 40)))
    put(f"{scratch}/d/e.csv", "")
    got = rows(read_log(spark, f"{scratch}/d", "csv"))
    assert got == sorted([("1", "x\ny"), ("2", 'he said "no", then\r\nleft'), ("3", 'plain, "q"'), ("4", '5" pipe'), *[(str(i), "v") for i in range(10, 40)]], key=str)


def test_a_plain_file_is_split_over_tasks(spark, scratch):
    p = put(f"{scratch}/big.csv", "a,b\n" + "".join(f'{i},"q ""{i}"""\n' for i in range(40_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        df = read_log(spark, p)
        assert df.rdd.getNumPartitions() > 8
        assert df.count() == 40_000 and df.select(F.countDistinct("b")).first()[0] == 40_000
        assert read_csv_log(spark, p, multi_line=True).rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_ndjson_whose_first_record_holds_quotes_and_brackets(spark, scratch):
    recs = [{"msg": 'say "[" now {', "n": 1}, {"msg": "\\", "n": 2}, {"msg": '"}]', "n": 3}]
    p = put(f"{scratch}/q.json", "".join(json.dumps(r) + "\n" for r in recs))
    assert rows(read_log(spark, p)) == [(r["msg"], r["n"]) for r in sorted(recs, key=lambda r: str((r["msg"], r["n"])))]


@pytest.mark.parametrize("junk", ["# note {", "[INFO] started", "{not json", "nope }", '"text"', "5"])
def test_ndjson_with_a_junk_first_line(spark, scratch, junk):
    p = put(f"{scratch}/j.json", junk + '\n{"a":1}\n\n  {"a":2} ,\r\n{"a":3} {"a":4}\n{"a":5\n{"a":6}')
    assert rows(read_log(spark, p)) == [(1,), (2,), (6,)]


def test_ndjson_values_beyond_json(spark, scratch):
    p = put(f"{scratch}/n.json", b'\xef\xbb\xbf{"a":NaN,"b":"NaN, ]"}\n{"a":1,"a":2,"b":"caf\xe9"}\n{"a":-Infinity,"b":null}\n')
    got = {(r["a"], r["b"]) for r in read_log(spark, p).collect()}
    assert got == {(None, "NaN, ]"), (2, "caf�"), (None, None)}


def test_one_line_wrapper_and_single_record(spark, scratch):
    p = put(f"{scratch}/w.json", '{"took":3,"hits":{"total":2,"hits":[{"ip":"a"},{"ip":"b"}]}}\n')
    assert rows(read_log(spark, p)) == [("a",), ("b",)]
    p = put(f"{scratch}/s.json", '{"ip":"a","n":{"x":1}}')
    df = read_log(spark, p)
    assert df.columns == ["ip", "n.x"] and rows(df) == [("a", 1)]
    assert rows(read_log(spark, put(f"{scratch}/l.json", '[{"ip":"a"},\n{"ip":"b"}, 7]'))) == [("a",), ("b",)]


def test_documents_of_a_folder_are_unwrapped_each_by_itself(spark, scratch):
    put(f"{scratch}/d/a.json", json.dumps({"meta": [{"k": 1}], "records": [{"ip": "a", "s": 1}, {"ip": "b", "s": 2}]}, indent=1))
    put(f"{scratch}/d/b.json", json.dumps({"meta": {"n": 1}, "hits": {"hits": [{"ip": "c", "s": 3}, {"ip": "d", "s": 4}, {"ip": "e"}]}}))
    put(f"{scratch}/d/c.json", json.dumps({"records": {"deep": [{"ip": "f", "s": 5}]}, "hits": 7}, indent=2))
    put(f"{scratch}/d/d.json", json.dumps([{"ip": "g", "s": 6}]))
    put(f"{scratch}/d/e.ndjson", '{"ip":"h","s":7}\n{"ip":"i","s":8}\n')
    put(f"{scratch}/d/f.json", json.dumps({"ip": "j", "s": 9, "mixed": [{"x": 1}, 2]}))
    df = read_log(spark, f"{scratch}/d", "json").select("ip", "s")
    assert rows(df) == sorted(zip("abcdefghij", [1, 2, 3, 4, None, 5, 6, 7, 8, 9], strict=True), key=str)


def test_largest_list_wins_and_lists_are_not_descended(spark, scratch):
    doc = {"a": [{"x": i} for i in range(3)], "b": {"c": [{"y": i, "inner": [{"z": 1}] * 9} for i in range(4)]}, "d": [1] * 9, "e": [], "f": [{"q": 1}, 2, 3, 4, 5]}
    df = read_log(spark, put(f"{scratch}/w.json", json.dumps(doc)))
    assert sorted(df.columns) == ["inner", "y"] and df.count() == 4


def test_keys_with_quotes_dots_and_depth(spark, scratch):
    deep = {"l1": {"l2": {"l3": {"l4": {"l5": 1}}}}}
    doc = {"it's": {"a.b": [{"k.1": 1, "o'k": "v", **deep}, {"k.1": 2.5, "o'k": 3, "e": {}}]}}
    df = read_log(spark, put(f"{scratch}/k.json", json.dumps(doc)))
    assert sorted(df.columns) == ["k.1", "l1.l2.l3.l4", "o'k"]
    got = sorted(((r["k.1"], r["o'k"], r["l1.l2.l3.l4"]) for r in df.collect()), key=str)
    assert got == [(1.0, "v", '{"l5":1}'), (2.5, "3", None)]


def test_errors(spark, scratch):
    for body, match in (("", "empty"), (" \n\t\n", "empty"), ("nope\nno\n", "not valid"), ("[]", "no records"), ('"text"', "no records"), ("{}", "no records")):
        with pytest.raises(ValueError, match=match):
            read_log(spark, put(f"{scratch}/e.json", body))
    with pytest.raises(ValueError, match="empty"):
        read_log(spark, put(f"{scratch}/e.csv", ""))


def test_a_document_too_large_for_a_row_is_an_error(spark, scratch, monkeypatch):
    from tidewatch.sources import logs
    monkeypatch.setattr(logs, "MAX_DOCUMENT_BYTES", 10)
    with pytest.raises(ValueError, match="document"):
        read_log(spark, put(f"{scratch}/b.json", json.dumps([{"a": 1}] * 5, indent=1)))
    assert read_log(spark, put(f"{scratch}/c.json", '{"a":1}\n' * 50)).count() == 50
