"""Stored versions: commits against a second writer, additive columns, one IP on the clustered layout."""

import json
import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import anomaly as A
from tidewatch.plans import pipeline as P
from tidewatch.plans.pipeline import ConcurrentVersionError, all_datasets, analyse_file, catalog, investigate_ip, reanalyse, table


def log(path, n=60, ip="45.1.2.3"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("timestamp,source_ip,status,username\n")
        for i in range(n):
            f.write(f"2024-01-01T10:{i // 60 % 60:02d}:{i % 60:02d}Z,{ip if i % 3 else f'81.9.{i % 7}.{i % 11}'},{'FAILED' if i % 3 else 'SUCCESS'},alice\n")
    return path


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("lake"))
    analyse_file(spark, log(f"{root}/in/a b.csv"), f"{root}/out", "a/b +%20")
    return f"{root}/out"


def test_two_runs_from_one_commit(spark, lake, monkeypatch):
    name = "a/b +%20"
    folder = f"{lake}/events/{P.quote(name, safe='')}"
    plain, inner = P.analyse, []

    def second_writer(*a, **k):
        if not inner:
            inner.append(True)
            reanalyse(spark, lake, name, {"status": "event_type"})     # starts later, is committed first
        return plain(*a, **k)

    monkeypatch.setattr(P, "analyse", second_writer)
    with pytest.raises(ConcurrentVersionError):
        reanalyse(spark, lake, name, {"status": None})
    now = P.dataset(spark, lake, name)
    assert now["commit"] == 2 and json.loads(now["overrides"]) == {"status": "event_type"}
    assert os.listdir(folder) == [now["version"]]           # neither the loser's tables nor the old ones
    assert table(spark, lake, "events", name).count() == 60
    assert P.newest_commit(spark, lake, name) == 2


def test_a_commit_is_never_overwritten(spark, scratch):
    P._commit(spark, scratch, "d", 1, {"dataset_id": "d", "version": "x"})
    with pytest.raises(ConcurrentVersionError):
        P._commit(spark, scratch, "d", 1, {"dataset_id": "d", "version": "y"})
    assert [r["version"] for r in catalog(spark, scratch).collect()] == ["x"]
    assert [f for f in os.listdir(f"{scratch}/catalog/d") if not f.endswith(".crc")] == ["000000000001.json"]


def test_older_versions_lack_columns(spark, lake, scratch):
    """A catalog file and an alerts table from before some columns came: both read, the columns null."""
    old = f"{scratch}/alerts/old/v0"
    spark.createDataFrame([("9.9.9.9", 71.0)], "source_ip string, risk_score double").write.parquet(old)
    now = P.dataset(spark, lake, "a/b +%20")
    P._commit(spark, scratch, "new", 1, {k: now[k] for k in ("dataset_id", "version", "filename", "uploaded_at")} | {"dataset_id": "new", "tables": now["tables"]})
    P._commit(spark, scratch, "old", 1, {"dataset_id": "old", "version": "v0", "tables": {"alerts": old}})
    rows = {r["dataset_id"]: r for r in catalog(spark, scratch).collect()}
    assert rows["old"]["overrides"] is None and rows["old"]["row_count"] is None and rows["new"]["filename"] == "a b.csv"
    a = all_datasets(spark, scratch, "alerts")
    assert a.columns == ["dataset_id", *table(spark, lake, "alerts", "a/b +%20").columns]
    got = a.where("dataset_id = 'old'").first()
    assert got["risk_score"] == 71.0 and got["classification"] is None and got["recommendation"] is None
    assert a.where("dataset_id = 'a/b +%20'").count() == table(spark, lake, "alerts", "a/b +%20").count() > 0
    assert all_datasets(spark, scratch, "events").select("dataset_id").distinct().count() == 1


def test_one_ip(spark, lake):
    i = investigate_ip(spark, lake, "a/b +%20", "45.1.2.3", 5)
    assert i.total_events == 40 and i.alert.count() == 1
    ts = [r["timestamp"] for r in i.events.collect()]
    assert len(ts) == 5 and ts == sorted(ts)
    assert i.progression.count() == i.detections.count()
    with pytest.raises(KeyError):
        investigate_ip(spark, lake, "a/b +%20", "1.1.1.1")
    with pytest.raises(KeyError):
        investigate_ip(spark, lake, "nobody", "45.1.2.3")
    with pytest.raises(ValueError):
        investigate_ip(spark, lake, "a/b +%20", "45.1.2.3", 0)


def test_one_ip_reads_few_row_groups(spark, scratch):
    spark.conf.set("parquet.block.size", str(16 * 1024))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        n = 30_000
        path = f"{scratch}/in/big.csv"
        os.makedirs(os.path.dirname(path))
        with open(path, "w") as f:
            f.write("timestamp,source_ip,status,username\n")
            f.writelines(f"2024-01-01T{i % 24:02d}:{i % 60:02d}:00Z,45.{i * 7 % 199}.{i % 13}.1,SUCCESS,u{i}\n" for i in range(n))
        at = {t: f"{scratch}/v/{t}" for t in P.TABLES}
        P._write_version(spark, path, at, "big", {}, None)
    finally:
        spark.conf.unset("parquet.block.size")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    groups = []
    for f in os.listdir(at["events"]):
        if f.endswith(".parquet"):
            meta = pq.ParquetFile(f"{at['events']}/{f}").metadata
            col = meta.schema.names.index("source_ip")
            groups += [meta.row_group(g).column(col).statistics for g in range(meta.num_row_groups)]
    mine = [s for s in groups if s.min <= "45.7.1.1" <= s.max]
    assert len(groups) >= 8 and len(mine) <= 2


def test_days_merge_to_the_whole(spark):
    from tidewatch.plans import queries as Q
    events = Q._sec(spark, "/root/testdata/sf0.001")
    day = F.coalesce(F.dayofmonth("timestamp"), F.lit(0))
    parts = [A.ip_state(events.where(day % 3 == k)) for k in range(3)]
    merged = A.profile_of(A.merge_ip_states(parts[0].unionByName(parts[1]).unionByName(parts[2])))
    key = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    whole = A.ip_profile(events)
    assert key(merged) == key(whole)
    assert "Expand" not in whole._jdf.queryExecution().toString()
    sketched = A.profile_of(A.merge_ip_states(A.ip_state(events.where(day % 2 == 0), True).unionByName(A.ip_state(events.where(day % 2 == 1), True)), True), True).drop("first_ts", "last_ts")
    exact = {r["source_ip"]: r for r in whole.collect()}
    for r in sketched.collect():
        e = exact[r["source_ip"]]
        assert all(abs(r[f] - e[f]) <= 0.1 * e[f] + 1e-9 for f in A.FEATURE_NAMES)
