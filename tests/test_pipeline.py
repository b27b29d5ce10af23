"""Upload -> analyse -> persist, and re-analysis that replaces (never mixes) results."""

import json
import os

import pytest

from tidewatch.operators.matching import UnknownOntologyFieldError
from tidewatch.plans import pipeline as P
from tidewatch.plans.pipeline import OverrideError, analyse_file, catalog, reanalyse, schema_view, table


def write_log(path):
    with open(path, "w") as f:
        f.write("timestamp,source_ip,status,username\n")
        for i in range(40):
            f.write(f"2024-01-01T10:00:{i:02d}Z,45.1.2.3,FAILED,alice\n")
        for i in range(40):
            f.write(f"2024-01-01T12:{i:02d}:00Z,81.9.9.{i % 5},SUCCESS,bob{i % 3}\n")
    return path


def test_analyse_then_reanalyse_replaces(spark, scratch):
    src = write_log(os.path.join(scratch, "auth.csv"))
    root = os.path.join(scratch, "lake")
    entry = analyse_file(spark, src, root, "auth")
    assert entry["row_count"] == 80
    det = table(spark, root, "detections", "auth").collect()
    assert {(r["detection_type"], r["source_ip"]) for r in det} == {("brute_force", "45.1.2.3")}
    alerts = table(spark, root, "alerts", "auth").collect()
    assert any(r["source_ip"] == "45.1.2.3" and 0 <= r["risk_score"] <= 100 for r in alerts)
    assert json.loads(det[0]["evidence_json"])["target_username"] == "alice"

    # force the failure signal off: the re-run has no detections, and none survive from before
    reanalyse(spark, root, "auth", {"status": None})
    det2 = table(spark, root, "detections", "auth")
    assert det2.count() == 0
    assert table(spark, root, "events", "auth").count() == 80
    cat = catalog(spark, root).collect()
    assert len(cat) == 1 and json.loads(cat[0]["overrides"]) == {"status": None}

    with pytest.raises(UnknownOntologyFieldError):
        reanalyse(spark, root, "auth", {"status": "not_a_field"})


def test_ids_never_mix_and_a_failed_run_changes_nothing(spark, scratch, monkeypatch):
    root = os.path.join(scratch, "lake")
    head = "timestamp,source_ip,status,username\n"
    for name, n in (("a", 3), ("b", 2)):
        with open(f"{scratch}/{name}.csv", "w") as f:
            f.write(head + "".join(f"2024-01-01T10:00:0{i}Z,45.1.2.{i},FAILED,u{i}\n" for i in range(n)))
    analyse_file(spark, f"{scratch}/a.csv", root, "00123")
    analyse_file(spark, f"{scratch}/b.csv", root, "123")
    assert table(spark, root, "events", "00123").count() == 3
    assert table(spark, root, "events", "123").count() == 2
    assert {r["column_name"]: r["mapped_field"] for r in schema_view(spark, root, "123").collect()}["source_ip"] == "source_ip"
    with pytest.raises(OverrideError):
        reanalyse(spark, root, "123", {"no_such_column": "port"})
    with pytest.raises(OverrideError):
        reanalyse(spark, root, "123", {"status": "username", "username": "username"})
    with pytest.raises(KeyError):
        table(spark, root, "events", "0123")

    def broken(*_a, **_k):
        raise RuntimeError("in mid-run")

    monkeypatch.setattr(P, "analyse", broken)
    with pytest.raises(RuntimeError):
        reanalyse(spark, root, "123", {"status": None})
    assert table(spark, root, "events", "123").count() == 2
    assert json.loads(catalog(spark, root).where("dataset_id = '123'").first()["overrides"]) == {}
