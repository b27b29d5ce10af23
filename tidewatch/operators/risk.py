"""Risk scoring per source IP (R-1 .. R-7).

score = 100 * (0.40 severity + 0.30 anomaly + 0.15 frequency + 0.15 confidence),
components rounded to 4 digits first, score to 1 digit, band on the unrounded
score. Candidates are IPs with a detection or an anomaly score >= 0.4.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numfmt import rnd

# ---- fixed values ------------------------------------------------------------
WEIGHTS = {"threat_severity": 0.40, "behavior_anomaly": 0.30, "frequency": 0.15, "confidence": 0.15}
BANDS = [(80, "Critical"), (60, "High"), (40, "Medium"), (0, "Low")]
CANDIDATE_ANOMALY = 0.4
VOLUME_SATURATION = 20
# -------------------------------------------------------------------------------


def classify(score: Column) -> Column:
    out = F.lit("Low")
    for thr, label in reversed(BANDS[:-1]):
        out = F.when(score >= thr, F.lit(label)).otherwise(out)
    return out


def ip_event_counts(events: DataFrame) -> DataFrame:
    """R-1: events per non-null source IP."""
    return events.where(F.col("source_ip").isNotNull()).groupBy("source_ip").agg(
        F.count(F.lit(1)).alias("event_count"))


def risk_profiles(detections: DataFrame, scores: DataFrame, mapping_confidence: float) -> DataFrame:
    """One row per candidate IP: components, risk_score, classification, event_count,
    top_features. ``scores`` has ``source_ip, event_count, anomaly_score, top_features``."""
    max_n = scores.agg(F.max("event_count")).collect()[0][0] or 0
    det = detections.groupBy("source_ip").agg(F.max("severity").alias("sev"))
    cand = (det.select("source_ip")
               .unionByName(scores.where(F.col("anomaly_score") >= CANDIDATE_ANOMALY).select("source_ip"))
               .distinct())
    j = cand.join(det, "source_ip", "left").join(scores, "source_ip", "left")
    n = F.coalesce(F.col("event_count"), F.lit(0)).cast("double")
    freq = (F.log1p(n) / F.lit(float(math.log1p(max_n)))) if max_n > 0 else F.lit(0.0)
    conf = F.lit(0.6) * F.least(F.lit(1.0), n / F.lit(float(VOLUME_SATURATION))) + F.lit(0.4 * mapping_confidence)
    comp = {
        "threat_severity": rnd(F.coalesce(F.col("sev"), F.lit(0.0)), 4),
        "behavior_anomaly": rnd(F.coalesce(F.col("anomaly_score"), F.lit(0.0)), 4),
        "frequency": rnd(freq, 4),
        "confidence": rnd(conf, 4),
    }
    j = j.select("source_ip", n.cast("long").alias("event_count"),
                 F.coalesce("top_features", F.array().cast("array<struct<feature:string,value:double>>"))
                  .alias("top_features"),
                 *[v.alias(k) for k, v in comp.items()])
    raw = F.lit(100.0) * (F.lit(WEIGHTS["threat_severity"]) * F.col("threat_severity")
                          + F.lit(WEIGHTS["behavior_anomaly"]) * F.col("behavior_anomaly")
                          + F.lit(WEIGHTS["frequency"]) * F.col("frequency")
                          + F.lit(WEIGHTS["confidence"]) * F.col("confidence"))
    return j.select("*", rnd(raw, 1).alias("risk_score"), classify(raw).alias("classification"))
