"""The analysis plan over a canonical event table: detect -> score -> explain.

Each of the three results that later steps read more than once - the per-IP
profile, its scores, the detections - is written to the shared folder, so
nothing is computed twice and nothing has to be kept in executor memory.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import anomaly as A
from ..operators import detect as D
from ..operators.explain import evidence_rows, explain
from ..operators.geo import geo_lookup
from ..operators.risk import risk_profiles
from ..session import cut_lineage


@dataclass
class Analysis:
    detections: DataFrame     # DETECTION_COLUMNS
    scores: DataFrame         # source_ip, features, top_features, anomaly_score
    alerts: DataFrame         # risk profile + explanation + geo
    evidence: DataFrame       # source_ip, detector_order, target, window_start, line


def analyse(events: DataFrame, order_col: str = "row_id", mapping_confidence: float = 1.0,
            anomaly_method: str = "forest", bucket_minutes: int | None = None) -> Analysis:
    # without a usable source IP every plan below yields zero rows by itself
    rules = cut_lineage(D.rule_detections(events, order_col, bucket_minutes))
    scores = cut_lineage(A.score_ips(cut_lineage(A.ip_profile(events)), anomaly_method))
    detections = rules.unionByName(A.unknown_anomalies(scores, rules))
    profiles = cut_lineage(risk_profiles(detections, scores, mapping_confidence))
    alerts = geo_lookup(explain(profiles, detections), "source_ip")
    return Analysis(detections, scores, alerts, evidence_rows(profiles, detections))


def store(result: Analysis, at: str) -> None:
    """Write the four tables of an analysis under a folder."""
    for f in fields(Analysis):
        getattr(result, f.name).write.parquet(f"{at}/{f.name}")


def stored(spark: SparkSession, at: str) -> Analysis:
    """An analysis that ``store`` has written."""
    return Analysis(**{f.name: spark.read.parquet(f"{at}/{f.name}") for f in fields(Analysis)})


def flat_alerts(alerts: DataFrame) -> DataFrame:
    """Alert rows with arrays/structs as text, for checking and CSV-like sinks."""
    return alerts.select(
        "source_ip", "risk_score", "classification", "threat_severity", "behavior_anomaly", "frequency",
        "confidence", "event_count", "threat",
        "confidence_pct", "reason", F.array_join("recommendation", " | ").alias("recommendation"),
        "country", "country_code", "lat", "lon")
