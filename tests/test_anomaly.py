"""The isolation forest: ranking, repeatability, full trees; detectors that stand down."""

from pyspark.sql import functions as F

from tidewatch.operators import anomaly as A
from tidewatch.operators import detect as D
from tidewatch.operators.matching import override_diff


def log(spark, n_ips, odd=3, partitions=2):
    """n_ips sources alike, the first ``odd`` of them at night with huge payloads to many ports."""
    base = spark.range(n_ips * 20).repartition(partitions).select((F.col("id") % n_ips).alias("k"), F.expr(f"id div {n_ips}").alias("j"))
    night = F.col("k") < odd
    return base.select(
        F.col("id") if "id" in base.columns else (F.col("k") * 20 + F.col("j")).alias("row_id"),
        F.concat(F.lit("10.0."), F.expr("k div 200").cast("string"), F.lit("."), (F.col("k") % 200).cast("string")).alias("source_ip"),
        F.expr("timestampadd(MINUTE, cast(j * 7 + k % 5 as int), TIMESTAMP_NTZ'2024-01-01 00:00:00')").alias("night_ts"),
        F.expr("timestampadd(MINUTE, cast(j * 7 + k % 5 as int), TIMESTAMP_NTZ'2024-01-01 10:00:00')").alias("day_ts"),
        F.lit(0.0).alias("failed_attempts"), F.when(night, F.col("j") * 100.0).otherwise(F.lit(443.0)).alias("port"),
        F.lit("10.9.9.9").alias("destination_ip"), F.lit("/x").alias("request_path"), F.lit("u").alias("username"),
        F.when(night, F.lit(1e6)).otherwise(F.lit(500.0) + F.col("k") % 7).alias("payload_size"), night.alias("odd"),
    ).withColumn("timestamp", F.when(F.col("odd"), F.col("night_ts")).otherwise(F.col("day_ts")))


def scores(df):
    return {r["source_ip"]: r["anomaly_score"] for r in A.anomaly_scores(df).collect()}


def test_planted_outliers_rank_first_and_scores_repeat(spark):
    one = scores(log(spark, 400))
    top = sorted(one, key=lambda ip: -one[ip])[:3]
    assert set(top) == {"10.0.0.0", "10.0.0.1", "10.0.0.2"} and all(one[ip] >= 0.7 for ip in top)
    assert one == scores(log(spark, 400, partitions=5))
    assert all(0 <= v <= 1 for v in one.values())


def test_every_tree_is_full(spark):
    z = spark.range(700).select(F.col("id").cast("string").alias("source_ip"), F.array(F.rand(1), F.rand(2)).alias("x"))
    counts = A._sample(z, 700, 256, 16.0).groupBy("tree").count().collect()
    assert len(counts) == A.N_TREES and all(r["count"] >= 256 for r in counts)


def test_few_sources_score_nothing(spark):
    rows = A.anomaly_scores(log(spark, 7)).collect()
    assert len(rows) == 7 and all(r["anomaly_score"] == 0.0 and not r["top_features"] for r in rows)


def test_detectors_stand_down(spark):
    df = log(spark, 5).withColumn("status_code", F.lit(200.0))
    gone = df.withColumn("username", F.lit(None).cast("string")).withColumn("port", F.lit(None).cast("double")) \
             .withColumn("request_path", F.lit(None).cast("string"))
    for f in (D.credential_spray, D.port_scan, D.endpoint_probe):
        assert f(gone, "row_id").count() == 0
    assert D.rule_detections(df.withColumn("source_ip", F.lit(None).cast("string")), "row_id").count() == 0


def test_a_flood_is_counted_before_the_window(spark):
    """2 000 failures of one source in each of 30 instants, beside a quiet one."""
    df = spark.range(60_000).select(
        F.lit("9.9.9.9").alias("source_ip"), F.lit("root").alias("username"), F.lit(1.0).alias("failed_attempts"),
        F.expr("timestampadd(MINUTE, cast(id % 30 as int), TIMESTAMP_NTZ'2024-01-01 00:00:00')").alias("timestamp"))
    hit = D.brute_force(df).first()
    assert hit["event_count"] == 22_000       # 11 instants lie within 10 minutes


def test_override_diff(spark):
    mk = lambda rows: spark.createDataFrame(rows, "column_name string, mapped_field string")
    d = override_diff(mk([("a", "port"), ("b", None), ("c", "username")]), mk([("a", "port"), ("b", "port"), ("c", None)]))
    assert {tuple(r) for r in d.collect()} == {("b", None, "port"), ("c", "username", None)}
