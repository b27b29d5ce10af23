"""Densest window (W-1) and first-k helpers against brute-force references."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidewatch.functions.firstk import first_k_distinct, first_k_rows
from tidewatch.operators.windows import densest_window, rows_in_window

T0 = dt.datetime(2024, 1, 1)


def two_pointer(ts, width):
    ts = sorted(ts)
    best = (1, ts[0], ts[0])
    left = 0
    for right in range(len(ts)):
        while ts[right] - ts[left] > width:
            left += 1
        if right - left + 1 > best[0]:
            best = (right - left + 1, ts[left], ts[right])
    return best


def test_densest_window_matches_two_pointer(spark):
    rng = random.Random(7)
    rows = []
    for g in range(300):
        n = rng.randint(1, 40)
        spread = rng.choice([60, 600, 3600, 86400])
        base = rng.randint(0, 5 * 86400)
        for _ in range(n):
            # heavy ties: whole seconds, sometimes repeated
            rows.append((f"g{g}", T0 + dt.timedelta(seconds=base + rng.randint(0, spread))))
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz")
    # a small bucket forces many bucket boundaries and context copies
    got = {r["k"]: (r["window_count"], r["window_start"], r["window_end"])
           for r in densest_window(df, ["k"], "ts", 10, bucket_minutes=10).collect()}
    by = {}
    for k, t in rows:
        by.setdefault(k, []).append(t)
    for k, ts in by.items():
        assert got[k] == two_pointer(ts, dt.timedelta(minutes=10)), k


def test_null_timestamps_are_ignored(spark):
    df = spark.createDataFrame([("a", None), ("a", T0), ("b", None)], "k string, ts timestamp_ntz")
    got = {r["k"]: r["window_count"] for r in densest_window(df, ["k"], "ts", 5).collect()}
    assert got == {"a": 1}


def test_rows_in_window_inclusive(spark):
    ts = [T0 + dt.timedelta(minutes=m) for m in (0, 1, 2, 30, 31)]
    df = spark.createDataFrame([("a", t, i) for i, t in enumerate(ts)], "k string, ts timestamp_ntz, i long")
    w = densest_window(df, ["k"], "ts", 2)
    inside = sorted(r["i"] for r in rows_in_window(df, w, ["k"], "ts", 2).collect())
    assert inside == [0, 1, 2]


def test_first_k_distinct_and_rows_exact(spark):
    rng = random.Random(3)
    rows = [(f"g{rng.randint(0, 4)}", f"v{rng.randint(0, 60)}", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v string, o long")
    got = {r["k"]: r["vals"] for r in first_k_distinct(df, ["k"], "v", "o", 10, "vals", salt=7).collect()}
    for k in {r[0] for r in rows}:
        seen = []
        for kk, v, _ in rows:
            if kk == k and v not in seen:
                seen.append(v)
        assert got[k] == seen[:10]
    top = first_k_rows(df, ["k"], [F.col("o").desc()], 5, salt=7)
    got_rows = {(r["k"], r["rank"]): r["o"] for r in top.collect()}
    for k in {r[0] for r in rows}:
        exp = sorted((o for kk, _, o in rows if kk == k), reverse=True)[:5]
        assert [got_rows[(k, i + 1)] for i in range(5)] == exp


def test_a_row_is_shuffled_once_to_its_bucket_and_small_buckets_are_left_out(spark):
    rows = [("a", 60 * k) for k in range(9)] + [("b", 3600 * k) for k in range(50)] + [("c", 3590), ("c", 3595), ("c", 3605)]
    df = spark.createDataFrame(rows, "g string, s long").select("g", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"))
    plain = {r["g"]: tuple(r)[1:] for r in densest_window(df, ["g"], "ts", 10).collect()}
    least = densest_window(df, ["g"], "ts", 10, least_of=F.lit(3))
    assert {r["g"]: tuple(r)[1:] for r in least.collect()} == {g: plain[g] for g in ("a", "c")}    # "b" has one row per bucket
    plan = least._jdf.queryExecution().optimizedPlan().toString()
    dealt = plan[plan.index("RepartitionByExpression"):]
    assert "array(-1" not in dealt and "-1 AS kind" not in dealt          # probes are made after the shuffle


def test_first_rows_need_one_rank(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), F.col("id").alias("v"))
    got = first_k_rows(df, ["g"], [F.col("v").desc()], 4)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    want = {(g, r, v) for g in range(3) for r, v in enumerate(sorted((x for x in range(5000) if x % 3 == g), reverse=True)[:4], 1)}
    assert {(r["g"], r["rank"], r["v"]) for r in got.collect()} == want
    many = first_k_rows(df, ["g"], [F.col("v")], 1200)                     # beyond what Spark limits before the shuffle
    assert many.count() == 3600 and many.where("g = 1").agg(F.max("v")).first()[0] == 1 + 3 * 1199
