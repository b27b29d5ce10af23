"""Template explanation of a risk profile (X-1 .. X-7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numfmt import int_text, rnd

# ---- fixed values: labels, recommendations and texts -----------------------------
THREAT_LABELS = {
    "brute_force": "Possible brute-force login attack",
    "credential_spray": "Possible credential spraying attack",
    "port_scan": "Possible port scanning / reconnaissance activity",
    "endpoint_probe": "Possible endpoint or web application probing",
    "unknown_anomaly": "Unclassified behavioural anomaly",
}
RECOMMENDATIONS = {
    "brute_force": [
        "Temporarily block or rate-limit this source IP",
        "Force a password reset for the targeted account",
        "Review authentication logs for this account over a longer time range",
    ],
    "credential_spray": [
        "Block the source IP temporarily",
        "Review all targeted accounts for signs of compromise",
        "Enforce multi-factor authentication on affected accounts",
        "Check authentication logs for the targeted usernames",
    ],
    "port_scan": [
        "Block or rate-limit the source IP at the firewall",
        "Verify which services are actually exposed on the scanned host(s)",
        "Enable alerting on any follow-up connection attempts from this IP",
    ],
    "endpoint_probe": [
        "Block the source IP or add a WAF rule for the requested paths",
        "Confirm the probed sensitive endpoints are not actually exposed",
        "Review server logs for any request that returned a 2xx response",
    ],
    "unknown_anomaly": [
        "Manually review this IP's full activity history",
        "Correlate with other log sources for additional context",
        "Consider temporary monitoring or throttling pending investigation",
    ],
}
NO_RULE_THREAT = "No rule-based threat matched; flagged purely on behavioural anomaly"
MULTIPLE_PREFIX = "Multiple threat indicators: "
BASELINE_LINE = "Activity differs from the dataset's normal baseline, notably in: "
REASON_RULE = "rule-based threat indicators"
REASON_BEHAVIOUR = "abnormal behavioural profile"
REASON_VOLUME = "high event volume"
REASON_PREFIX = "Elevated risk driven by "
REASON_LOW = "Low overall risk indicators."
BEHAVIOUR_MIN = 0.4
BASELINE_ORDER = 9          # after every detector
VOLUME_MIN = 0.6
# ------------------------------------------------------------------------------------


def _map(d: dict) -> Column:
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v) if isinstance(v, str)
                                                            else F.array(*[F.lit(s) for s in v]))])


def _feature_names(arr: Column) -> Column:
    return F.array_join(F.transform(arr, lambda f: F.regexp_replace(f["feature"], "_", " ")), ", ")


def evidence_line(d: DataFrame) -> Column:
    """Evidence sentence of one detection row (X-4)."""
    e = lambda n: F.col("evidence." + n)
    s = lambda c: c.cast("string")
    mins = int_text(e("window_minutes"))
    bf = F.concat(s(e("failed_attempts_in_window")), F.lit(" failed authentication attempts against user '"),
                  e("target_username"), F.lit("' within "), mins, F.lit(" minutes"))
    cs = F.concat(F.lit("Contacted "), s(e("distinct_usernames_targeted")), F.lit(" distinct user accounts with "),
                  s(e("total_failed_attempts")), F.lit(" failed attempts ("), s(e("avg_attempts_per_user")),
                  F.lit(" attempts/user on average) within "), mins, F.lit(" minutes"))
    ps = F.concat(F.lit("Contacted "), s(e("distinct_ports_contacted")), F.lit(" distinct ports on "),
                  s(F.size(e("target_hosts"))), F.lit(" host(s) within "), mins, F.lit(" minutes"),
                  F.when(e("sequential_pattern"), F.lit(" (sequential scan pattern detected)")).otherwise(F.lit("")))
    ep = F.concat(F.lit("Requested "), s(e("distinct_paths_requested")), F.lit(" distinct paths with a "),
                  int_text(e("error_response_ratio") * F.lit(100.0)), F.lit("% error-response rate"),
                  F.when(e("suspicious_path_hits") > 0,
                         F.concat(F.lit(", including "), s(e("suspicious_path_hits")),
                                  F.lit(" hits on known-sensitive paths"))).otherwise(F.lit("")))
    ua = F.concat(F.lit("Behaviour differs from the normal baseline for this dataset (anomaly score "),
                  int_text(e("anomaly_score") * F.lit(100.0)), F.lit("%), notably in: "),
                  _feature_names(e("deviating_features")))
    t = F.col("detection_type")
    body = (F.when(t == "brute_force", bf).when(t == "credential_spray", cs).when(t == "port_scan", ps)
             .when(t == "endpoint_probe", ep).when(t == "unknown_anomaly", ua))
    return F.concat(F.lit("IP "), F.col("source_ip"), F.lit(": "), body)


def _target() -> Column:
    return F.coalesce(F.col("evidence.target_username"), F.lit(""))


def evidence_rows(profiles: DataFrame, detections: DataFrame) -> DataFrame:
    """The evidence of each IP as rows (X-4), a line per detection, in the order of
    ``detector_order, target, window_start, line``; an IP may have any number of them."""
    of_rules = detections.select("source_ip", "detector_order", _target().alias("target"), "window_start",
                                 evidence_line(detections).alias("line"))
    unknown = detections.where(F.col("detection_type") == "unknown_anomaly").select("source_ip").distinct()
    quiet = profiles.where((F.col("behavior_anomaly") >= BEHAVIOUR_MIN) & (F.size("top_features") > 0))
    baseline = quiet.join(unknown, "source_ip", "left_anti").select(
        "source_ip", F.lit(BASELINE_ORDER).alias("detector_order"), F.lit("").alias("target"),
        F.lit(None).cast(detections.schema["window_start"].dataType).alias("window_start"),
        F.concat(F.lit(BASELINE_LINE), _feature_names(F.col("top_features"))).alias("line"))
    return of_rules.join(profiles.select("source_ip"), "source_ip", "left_semi").unionByName(baseline)


def detection_summary(detections: DataFrame) -> DataFrame:
    """Per IP: sorted distinct types (at most five) and the dominant type."""
    return detections.groupBy("source_ip").agg(
        F.array_sort(F.collect_set("detection_type")).alias("types"),
        F.min_by("detection_type", F.struct(-F.col("severity"), F.col("detector_order"), _target())).alias("dominant"))


def explain(profiles: DataFrame, detections: DataFrame) -> DataFrame:
    """Add threat, confidence_pct, reason, recommendation to risk profiles."""
    s = detection_summary(detections)
    j = profiles.join(s, "source_ip", "left")
    labels, recs = _map(THREAT_LABELS), _map(RECOMMENDATIONS)
    has_det = F.col("dominant").isNotNull()
    threat = (F.when(~has_det, F.lit(NO_RULE_THREAT))
               .when(F.size("types") > 1, F.concat(F.lit(MULTIPLE_PREFIX),
                                                   F.array_join(F.transform("types", lambda t: labels[t]), ", ")))
               .otherwise(labels[F.col("dominant")]))
    rec = F.when(has_det, recs[F.col("dominant")]).otherwise(recs[F.lit("unknown_anomaly")])
    parts = F.filter(F.array(F.when(F.col("threat_severity") > 0, F.lit(REASON_RULE)),
                             F.when(F.col("behavior_anomaly") >= BEHAVIOUR_MIN, F.lit(REASON_BEHAVIOUR)),
                             F.when(F.col("frequency") >= VOLUME_MIN, F.lit(REASON_VOLUME))),
                     lambda x: x.isNotNull())
    reason = F.when(F.size(parts) > 0, F.concat(F.lit(REASON_PREFIX), F.array_join(parts, " and "), F.lit(".")))\
              .otherwise(F.lit(REASON_LOW))
    return j.select(*profiles.columns, threat.alias("threat"),
                    rnd(F.col("confidence") * F.lit(100.0), 1).alias("confidence_pct"),
                    reason.alias("reason"), rec.alias("recommendation"))

