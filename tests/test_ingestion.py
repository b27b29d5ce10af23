"""Reader, profiler, matcher and normaliser contracts on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from tidewatch.operators.matching import UnknownOntologyFieldError, map_columns
from tidewatch.operators.normalize import to_canonical
from tidewatch.operators.profile import profile
from tidewatch.sources.logs import UnsupportedFileTypeError, read_log, with_row_id

ROWS3 = [("10.0.0.1", "192.168.1.10", "3", "2024-01-01T10:00:00Z"),
         ("10.0.0.2", "192.168.1.11", "0", "2024-01-01T10:01:00Z"),
         ("10.0.0.3", "192.168.1.12", "5", "2024-01-01T10:02:00Z")]


def write_csv(path, header, rows):
    with open(path, "w") as f:
        f.write(",".join(header) + "\n")
        for r in rows:
            f.write(",".join(r) + "\n")
    return path


def mapping(spark, paths, overrides=None):
    ds = [(n, with_row_id(read_log(spark, p))) for n, p in paths.items()]
    m = map_columns(profile(ds), overrides)
    return {(r["dataset_id"], r["column_name"]): (r["mapped_field"], r["confidence"], r["source"])
            for r in m.collect()}


def test_three_schemas_map_to_same_fields(spark, scratch):
    names = {"a1": ["source_ip", "destination_ip", "failed_attempts", "timestamp"],
             "a2": ["src_addr", "dst_host", "login_fail", "event_time"],
             "a3": ["client_ip", "server_ip", "authentication_errors", "created_at"]}
    paths = {k: write_csv(f"{scratch}/{k}.csv", v, ROWS3) for k, v in names.items()}
    m = mapping(spark, paths)
    want = ["source_ip", "destination_ip", "failed_attempts", "timestamp"]
    for k, cols in names.items():
        assert [m[(k, c)][0] for c in cols] == want
        assert all(0.0 <= m[(k, c)][1] <= 1.0 for c in cols)


def test_unrelated_columns_stay_unmapped_and_are_kept(spark, scratch):
    header = ["source_ip", "destination_ip", "failed_attempts", "timestamp", "internal_case_ref", "cost_centre_code"]
    rows = [r + (f"CASE-00{i}", f"CC-{9 - i}") for i, r in enumerate(ROWS3)]
    p = write_csv(f"{scratch}/a4.csv", header, rows)
    m = mapping(spark, {"a4": p})
    assert m[("a4", "internal_case_ref")][0] is None
    assert m[("a4", "cost_centre_code")][0] is None
    raw = read_log(spark, p)
    ev = to_canonical(raw, [(c, m[("a4", c)][0]) for c in header])
    extra = [json.loads(r["extra_fields"]) for r in ev.collect()]
    assert {e["internal_case_ref"] for e in extra} == {"CASE-000", "CASE-001", "CASE-002"}


def test_single_ip_column_becomes_source(spark, scratch):
    p = write_csv(f"{scratch}/a11.csv", ["rhost", "user", "result"],
                  [(f"203.0.113.{i}", "alice", "FAILED") for i in range(5)])
    assert mapping(spark, {"a11": p})[("a11", "rhost")][0] == "source_ip"


def test_misleading_counter_then_override(spark, scratch):
    rows = [(f"2024-01-01T10:{i // 2:02d}:{(i % 2) * 30:02d}Z", f"45.1.2.{i % 4}",
             "FAILED" if i % 2 == 0 else "SUCCESS", f"user{i % 5}", "3") for i in range(80)]
    header = ["timestamp", "source_ip", "status", "username", "request_count"]
    p = write_csv(f"{scratch}/a18.csv", header, rows)
    m = mapping(spark, {"a18": p})
    assert m[("a18", "request_count")][0] == "failed_attempts"      # fooled, as the reference is
    fixed = mapping(spark, {"a18": p}, {"a18": {"status": "failed_attempts", "request_count": None}})
    assert fixed[("a18", "status")] == ("failed_attempts", 1.0, "manual")
    assert fixed[("a18", "request_count")][0] is None
    raw = read_log(spark, p)
    ev = to_canonical(raw, [(c, fixed[("a18", c)][0]) for c in header])
    assert ev.agg(F.sum("failed_attempts")).collect()[0][0] == 40
    with pytest.raises(UnknownOntologyFieldError):
        mapping(spark, {"a18": p}, {"a18": {"status": "no_such_field"}})


def test_failure_indicator_from_text(spark, scratch):
    p = write_csv(f"{scratch}/a19.csv", ["status", "source_ip"],
                  [(s, "1.2.3.4") for s in ["FAILED", "SUCCESS", "denied", "ok", "Invalid password"]])
    raw = with_row_id(read_log(spark, p))
    ev = to_canonical(raw, [("status", "failed_attempts"), ("source_ip", "source_ip")], keep=["row_id"])
    assert [r["failed_attempts"] for r in ev.orderBy("row_id").collect()] == [1, 0, 1, 0, 1]


def test_malformed_values_become_null(spark, scratch):
    p = write_csv(f"{scratch}/a5.csv", ["source_ip", "failed_attempts", "timestamp"],
                  [("not-an-ip", "3", "2024-01-01T10:00:00Z"), ("10.0.0.1", "oops", "garbage"),
                   ("10.0.0.2", "", "")])
    raw = with_row_id(read_log(spark, p))
    ev = to_canonical(raw, [("source_ip", "source_ip"), ("failed_attempts", "failed_attempts"),
                            ("timestamp", "timestamp")], keep=["row_id"]).orderBy("row_id").collect()
    assert [r["failed_attempts"] for r in ev] == [3.0, None, None]
    assert ev[0]["timestamp"] is not None and ev[1]["timestamp"] is None and ev[2]["timestamp"] is None


def test_csv_long_rows_skipped_short_rows_padded(spark, scratch):
    p = f"{scratch}/ragged.csv"
    with open(p, "w") as f:
        f.write("a,b,c\n1,2,3\n4,5\n6,7,8,9\nNA,n/a,x\n")
    rows = [tuple(r) for r in read_log(spark, p).collect()]
    assert rows == [("1", "2", "3"), ("4", "5", None), (None, None, "x")]


def test_json_shapes(spark, scratch):
    wrapped = {"took": 3, "hits": {"total": 40, "hits": [
        {"@timestamp": f"2024-01-01T10:00:{i:02d}Z", "client": {"address": f"1.2.3.{i}"},
         "url": {"path": "/x"}, "http": {"response": {"status_code": 200}}} for i in range(40)]}}
    with open(f"{scratch}/w.json", "w") as f:
        json.dump(wrapped, f)
    df = read_log(spark, f"{scratch}/w.json")
    assert df.count() == 40
    assert "client.address" in df.columns and "http.response.status_code" in df.columns
    with open(f"{scratch}/n.json", "w") as f:
        for i in range(20):
            f.write(json.dumps({"time": f"2024-01-01T10:00:{i:02d}Z", "src": "1.1.1.1", "usr": "u"}) + "\n")
        f.write("not json\n")
    assert read_log(spark, f"{scratch}/n.json").count() == 20
    with open(f"{scratch}/e.json", "w") as f:
        f.write("")
    with pytest.raises(ValueError):
        read_log(spark, f"{scratch}/e.json")
    with pytest.raises(UnsupportedFileTypeError):
        read_log(spark, f"{scratch}/x.xml")


def text(path, body, mode="w"):
    with open(path, mode) as f:
        f.write(body)
    return path


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_csv_quotes_newlines_and_widths(spark, scratch):
    p = text(f"{scratch}/q.csv", 'a,b\n1,"he said ""hi"", ok"\n2,"x\ny"\n3,z,,w\n4,z,\n5\n')
    assert rows(read_log(spark, p)) == [("1", 'he said "hi", ok'), ("2", "x\ny"), ("5", None)]


def test_encoding_is_decided_per_file(spark, scratch):
    import os
    os.makedirs(f"{scratch}/d")
    text(f"{scratch}/d/u.csv", "a\n\u00e9\ufffd\n".encode(), "wb")
    text(f"{scratch}/d/l.csv", "a\n\u00e8\n".encode("latin-1"), "wb")
    assert sorted(rows(read_log(spark, f"{scratch}/d", "csv"))) == [("\u00e8",), ("\u00e9\ufffd",)]


def test_wrapped_document_with_an_object_per_line(spark, scratch):
    p = text(f"{scratch}/w.json", '{"meta":[\n{"k":1},\n{"k":2}\n],"records":[\n{"ip":"a","s":1},\n{"ip":"b","s":2},\n{"ip":"c","s":3}\n]}')
    df = read_log(spark, p)
    assert df.columns == ["ip", "s"] and rows(df) == [("a", 1), ("b", 2), ("c", 3)]
    p = text(f"{scratch}/j.json", '# note {\n{"a":1}\n{"a":2}\n')
    assert rows(read_log(spark, p)) == [(1,), (2,)]


def test_row_order_follows_files(spark, scratch):
    import os
    os.makedirs(f"{scratch}/two")
    text(f"{scratch}/two/a.csv", "a\n1\n")
    text(f"{scratch}/two/b.csv", "a\n" + "".join(f"{i}\n" for i in range(2, 200)))
    got = with_row_id(read_log(spark, f"{scratch}/two", "csv")).orderBy("row_id").collect()
    assert [int(r["a"]) for r in got] == list(range(1, 200))


def test_boolean_failures_count(spark, scratch):
    p = text(f"{scratch}/b.json", '{"failed":true,"ip":"1.2.3.4"}\n{"failed":false,"ip":"1.2.3.5"}\n{"failed":true,"ip":"1.2.3.6"}\n')
    raw = with_row_id(read_log(spark, p))
    ev = to_canonical(raw, [("failed", "failed_attempts"), ("ip", "source_ip")], keep=["row_id"])
    assert [r["failed_attempts"] for r in ev.orderBy("row_id").collect()] == [1.0, 0.0, 1.0]
    assert {r["column_name"]: r["inferred_dtype"] for r in profile([("b", raw)]).collect()}["failed"] == "float"
    with pytest.raises(ValueError):
        to_canonical(raw, [("failed", "failed_attempts"), ("ip", "failed_attempts")])


def test_timestamp_layouts(spark):
    from tidewatch.functions.timeparse import parse_ts
    want = {"1 Jan 2024 10:00:00": "2024-01-01 10:00:00", "01-02-2024 10:00": "2024-01-02 10:00:00",
            "Mon, 01 Jan 2024 10:00:00 GMT": "2024-01-01 10:00:00", "20240101T101010": "2024-01-01 10:10:10",
            "2024-01-01 10:00 PM": "2024-01-01 22:00:00", "Jan 5, 2024": "2024-01-05 00:00:00",
            "2024-01-01T10:00:00Z": "2024-01-01 10:00:00", "garbage": None, "12:30": None}
    df = spark.createDataFrame([(k,) for k in want], "x string").select("x", parse_ts(F.col("x")).cast("string").alias("t"))
    assert {r["x"]: r["t"] for r in df.collect()} == want


def test_head_sample_and_whole_table_differ(spark, scratch):
    p = write_csv(f"{scratch}/h.csv", ["v"], [("red",)] * 1000 + [(f"x{i}",) for i in range(200)])
    df = with_row_id(read_log(spark, p))
    assert profile([("h", df)], 1000).first()["inferred_dtype"] == "categorical"
    assert profile([("h", df)]).first()["inferred_dtype"] == "string"
