"""Serving views over events, detections and alerts (Q-1 .. Q-12).

Every view is one DataFrame query; all aggregation runs in the executors and
only the (small) answer reaches the caller.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.firstk import first_k_rows
from ..functions.numfmt import rnd
from ..functions.timecols import epoch_us, from_epoch_us
from ..operators.detect import DETECTOR_ORDER

BANDS = ["Critical", "High", "Medium", "Low"]
DETECTION_TYPES = list(DETECTOR_ORDER)
DEFAULT_BUCKET_MINUTES = 30
DEFAULT_ALERT_LIMIT = 100
DEFAULT_TOP_N = 10
DEFAULT_EVENT_LIMIT = 200
BEHAVIOUR_VIEW_MIN = 0.5


def overview(events: DataFrame, detections: DataFrame, alerts: DataFrame) -> DataFrame:
    """Q-1: one row of KPIs."""
    spark = events.sparkSession
    return spark.range(1).select(
        events.select(F.count(F.lit(1))).scalar().alias("total_events"),
        events.select(F.countDistinct("source_ip")).scalar().alias("unique_source_ips"),
        detections.select(F.count(F.lit(1))).scalar().alias("threats_detected"),
        alerts.select(F.count_if(F.col("classification") == "Critical")).scalar().alias("critical_alerts"))


def risk_distribution(alerts: DataFrame) -> DataFrame:
    """Q-1 / Q-5: alerts per band, zero-filled over the four bands."""
    spark = alerts.sparkSession
    bands = spark.createDataFrame([(b, i) for i, b in enumerate(BANDS)], "classification string, band_order int")
    counts = alerts.groupBy("classification").agg(F.count(F.lit(1)).alias("alerts"))
    return (F.broadcast(bands).join(counts, "classification", "left")
            .select("classification", "band_order", F.coalesce("alerts", F.lit(0)).cast("long").alias("alerts")))


def attack_categories(detections: DataFrame) -> DataFrame:
    """Q-9 (and the overview's type counts): detections per type, most frequent first."""
    return (detections.groupBy("detection_type").agg(F.count(F.lit(1)).alias("detections"))
            .orderBy(F.col("detections").desc(), "detection_type"))


def _bucket(ts: Column, minutes: int) -> Column:
    b = minutes * 60_000_000
    us = epoch_us(ts)
    return from_epoch_us(us - F.pmod(us, F.lit(b)))


def timeline_volume(events: DataFrame, bucket_minutes: int = DEFAULT_BUCKET_MINUTES) -> DataFrame:
    """Q-2: events per epoch-floored bucket (null timestamps skipped)."""
    if not 1 <= bucket_minutes <= 1440:
        raise ValueError("bucket_minutes must be within 1..1440")
    return (events.where(F.col("timestamp").isNotNull())
            .groupBy(_bucket(F.col("timestamp"), bucket_minutes).alias("bucket"))
            .agg(F.count(F.lit(1)).alias("total_events")))


def _detection_buckets(detections: DataFrame, bucket_minutes: int) -> DataFrame:
    d = detections.where(F.col("window_start").isNotNull())
    return (d.groupBy(_bucket(F.col("window_start"), bucket_minutes).alias("bucket"))
             .pivot("detection_type", DETECTION_TYPES).agg(F.count(F.lit(1))).na.fill(0, DETECTION_TYPES))


def timeline(events: DataFrame, detections: DataFrame, bucket_minutes: int = DEFAULT_BUCKET_MINUTES) -> DataFrame:
    """Q-2: event volume per bucket with detection counts by type at ``window_start``;
    only buckets with events appear."""
    vol = timeline_volume(events, bucket_minutes)
    det = _detection_buckets(detections, bucket_minutes)
    j = vol.join(det, "bucket", "left")
    return j.select("bucket", "total_events",
                    *[F.coalesce(F.col(t), F.lit(0)).cast("long").alias(t) for t in DETECTION_TYPES])


def timeline_pivot(events: DataFrame, detections: DataFrame,
                   bucket_minutes: int = DEFAULT_BUCKET_MINUTES) -> DataFrame:
    """Q-3: the timeline restricted to buckets that hold detections."""
    t = timeline(events, detections, bucket_minutes)
    any_det = None
    for c in DETECTION_TYPES:
        any_det = F.col(c) > 0 if any_det is None else (any_det | (F.col(c) > 0))
    return t.where(any_det)


def alerts_topk(alerts: DataFrame, classification: str | None = None,
                limit: int = DEFAULT_ALERT_LIMIT) -> DataFrame:
    """Q-4: alerts by risk (desc), optional band filter, 1..1000 rows."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be within 1..1000")
    a = alerts if classification is None else alerts.where(F.col("classification") == classification)
    return a.orderBy(F.col("risk_score").desc(), "source_ip").limit(limit)


def ip_totals(events: DataFrame, detections: DataFrame, alerts: DataFrame) -> DataFrame:
    """Q-6 summary for every investigated IP (one with an alert or a detection)."""
    ips = alerts.select("source_ip").unionByName(detections.select("source_ip")).distinct()
    ev = events.where(F.col("source_ip").isNotNull()).groupBy("source_ip").agg(
        F.count(F.lit(1)).alias("total_events"))
    de = detections.groupBy("source_ip").agg(F.count(F.lit(1)).alias("detections"))
    return (ips.join(ev, "source_ip", "left").join(de, "source_ip", "left")
            .select("source_ip", F.coalesce("total_events", F.lit(0)).alias("total_events"),
                    F.coalesce("detections", F.lit(0)).alias("detections")))


def ip_events(events: DataFrame, ips: DataFrame, order_col: str = "row_id",
              event_limit: int = DEFAULT_EVENT_LIMIT) -> DataFrame:
    """Q-6: the first ``event_limit`` events by time (nulls last, then row order) of each IP in ``ips``."""
    if not 1 <= event_limit <= 2000:
        raise ValueError("event_limit must be within 1..2000")
    ev = events.join(ips.select("source_ip").distinct(), "source_ip", "left_semi")
    return first_k_rows(ev, ["source_ip"], [F.col("timestamp").asc_nulls_last(), F.col(order_col)],
                        event_limit, rank_col="event_rank")


@dataclass
class Investigation:
    """Q-6: all that is known of one source IP."""

    total_events: int
    alert: DataFrame          # no row or one
    detections: DataFrame     # by window_start
    progression: DataFrame
    events: DataFrame         # the first by time


def investigate(events: DataFrame, detections: DataFrame, alerts: DataFrame, source_ip: str, order_col: str = "row_id",
                event_limit: int = DEFAULT_EVENT_LIMIT) -> Investigation:
    """Q-6 for one IP; an IP with neither an alert nor a detection is a KeyError.

    Stored events lie sorted by (source_ip, timestamp), so that the filter skips nearly all row groups.
    """
    if not 1 <= event_limit <= 2000:
        raise ValueError("event_limit must be within 1..2000")
    alert, found, own = (df.where(F.col("source_ip") == source_ip) for df in (alerts, detections, events))
    if not alert.take(1) and not found.take(1):
        raise KeyError(f"No analysis found for IP {source_ip} in this dataset")
    first = own.orderBy(F.col("timestamp").asc_nulls_last(), order_col).limit(event_limit)
    return Investigation(own.count(), alert, found.orderBy(F.col("window_start").asc_nulls_first(), "detector_order"),
                         attack_progression(found), first)


def attack_progression(detections: DataFrame) -> DataFrame:
    """Q-7: each IP's detections in time order, five fields and a step number.

    A step is the place within the IP's hour plus the detections of its earlier hours, so an IP with
    any number of detections is ranked hour by hour in many tasks.
    """
    stored = "evidence_json" in detections.columns
    key = F.get_json_object("evidence_json", "$.target_username") if stored else F.col("evidence.target_username")
    key = F.coalesce(key, F.lit(""))
    d = detections.withColumn("_h", F.date_trunc("hour", "window_start"))
    order = [F.col("window_start").asc_nulls_first(), F.col("detector_order"), key]
    place = F.row_number().over(Window.partitionBy("source_ip", "_h").orderBy(*order))
    hours = d.groupBy("source_ip", "_h").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("source_ip").orderBy(F.col("_h").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.select(F.col("source_ip").alias("_ip"), F.col("_h").alias("_at"),
                         F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    j = d.withColumn("_place", place).join(hours, (F.col("source_ip") == F.col("_ip")) & F.col("_h").eqNullSafe(F.col("_at")))
    return j.select("source_ip", (F.col("_place") + F.col("_before")).cast("int").alias("step"), "detection_type",
                    "window_start", "window_end", "severity", "event_count")


def top_offenders(alerts: DataFrame, top_n: int = DEFAULT_TOP_N) -> DataFrame:
    """Q-8: the ``top_n`` (1..100) riskiest IPs."""
    if not 1 <= top_n <= 100:
        raise ValueError("top_n must be within 1..100")
    return alerts.orderBy(F.col("risk_score").desc(), "source_ip").limit(top_n)


def geo_distribution(alerts: DataFrame) -> DataFrame:
    """Q-10: alerts per country; mean risk (1 digit); coordinates of the riskiest alert with coordinates."""
    order = F.struct(-F.col("risk_score"), F.col("source_ip"))
    has = F.col("lat").isNotNull()
    g = alerts.groupBy(F.coalesce("country", F.lit("Unknown")).alias("country"),
                       F.coalesce("country_code", F.lit("XX")).alias("country_code")).agg(
        F.count(F.lit(1)).alias("alert_count"),
        rnd(F.avg("risk_score"), 1).alias("avg_risk_score"),
        F.min_by(F.when(has, F.col("lat")), F.when(has, order)).alias("lat"),
        F.min_by(F.when(has, F.col("lon")), F.when(has, order)).alias("lon"))
    return g.orderBy(F.col("alert_count").desc(), "country")


def behaviour_anomalies(alerts: DataFrame, top_n: int = DEFAULT_TOP_N) -> DataFrame:
    """Q-11: riskiest alerts whose anomaly component is >= 0.5."""
    return (alerts.where(F.col("behavior_anomaly") >= BEHAVIOUR_VIEW_MIN)
            .orderBy(F.col("risk_score").desc(), "source_ip").limit(top_n))


def peak_risk(alerts: DataFrame, detections: DataFrame) -> DataFrame:
    """Q-12: peak score and its IP, elevated (Critical + High) count, number of types fired."""
    return alerts.agg(
        F.max("risk_score").alias("peak_risk_score"),
        F.min_by("source_ip", F.struct(-F.col("risk_score"), F.col("source_ip"))).alias("peak_source_ip"),
        F.count_if(F.col("classification").isin("Critical", "High")).alias("elevated_alerts"),
        detections.select(F.countDistinct("detection_type")).scalar().alias("types_fired"))
