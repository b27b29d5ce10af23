"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

All of them read the ``sec`` fixture (or other test-data tables) whole; the
matching DuckDB SQL lives in :mod:`.oracle`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rules import is_suspicious_path
from ..operators import detect as det
from ..operators.windows import densest_window, rows_in_window
from ..session import apply_engine_conf, cut_lineage
from ..sources.fixture import sec_table
from . import oracle as O

ORDER = "event_id"   # row order of the fixture


def _sec(spark: SparkSession, sf: str) -> DataFrame:
    apply_engine_conf(spark)
    return sec_table(spark, sf)


def _common(df: DataFrame) -> list:
    return ["detection_type", "source_ip", "window_start", "window_end", "severity", "event_count"]


def q_brute_force(spark, sf):
    d = det.brute_force(_sec(spark, sf))
    return d.select(*_common(d), F.col("evidence.target_username").alias("target_username"),
                    F.col("evidence.failed_attempts_in_window").alias("failed_attempts_in_window"),
                    F.col("evidence.window_minutes").alias("window_minutes"))


def q_credential_spray(spark, sf):
    d = det.credential_spray(_sec(spark, sf), ORDER)
    e = "evidence."
    return d.select(*_common(d), F.col(e + "distinct_usernames_targeted").alias("distinct_usernames_targeted"),
                    F.col(e + "total_failed_attempts").alias("total_failed_attempts"),
                    F.col(e + "avg_attempts_per_user").alias("avg_attempts_per_user"),
                    F.array_join("targeted_usernames", ",").alias("targeted_usernames"),
                    F.col(e + "window_minutes").alias("window_minutes"))


def q_port_scan(spark, sf):
    d = det.port_scan(_sec(spark, sf), ORDER)
    e = "evidence."
    return d.select(*_common(d), F.col(e + "distinct_ports_contacted").alias("distinct_ports_contacted"),
                    F.array_join(e + "target_hosts", ",").alias("target_hosts"),
                    F.col(e + "sequential_pattern").alias("sequential_pattern"),
                    F.col(e + "sequential_ratio").alias("sequential_ratio"),
                    F.col(e + "window_minutes").alias("window_minutes"))


def q_endpoint_probe(spark, sf):
    d = det.endpoint_probe(_sec(spark, sf), ORDER)
    e = "evidence."
    return d.select(*_common(d), F.col(e + "distinct_paths_requested").alias("distinct_paths_requested"),
                    F.col(e + "error_response_ratio").alias("error_response_ratio"),
                    F.col(e + "suspicious_path_hits").alias("suspicious_path_hits"),
                    F.array_join(e + "sample_paths", ",").alias("sample_paths"),
                    F.col(e + "window_minutes").alias("window_minutes"))


def _failed_rows(spark, sf):
    s = _sec(spark, sf)
    return s.where((F.coalesce("failed_attempts", F.lit(0.0)) >= 1) & F.col("source_ip").isNotNull()
                   & F.col("timestamp").isNotNull())


def q_densest_window(spark, sf):
    return densest_window(_failed_rows(spark, sf), ["source_ip"], "timestamp", 10)


def q_rows_in_window(spark, sf):
    f = _failed_rows(spark, sf).select("event_id", "source_ip", "timestamp")
    w = densest_window(f, ["source_ip"], "timestamp", 10)
    return rows_in_window(f, w, ["source_ip"], "timestamp", 10)


def q_sequential_ratio(spark, sf):
    s = _sec(spark, sf).where(F.col("source_ip").isNotNull() & F.col("port").isNotNull())
    ports = s.select("source_ip", F.col("port").cast("long").alias("port")).distinct()
    return det.port_gaps(ports, ["source_ip"], "port")


def q_suspicious_paths(spark, sf):
    s = _sec(spark, sf).where(F.col("request_path").isNotNull())
    return s.groupBy("request_path").agg(F.count(F.lit(1)).alias("hits")) \
            .withColumn("suspicious", is_suspicious_path(F.col("request_path")))


def q_all_detections(spark, sf):
    d = det.rule_detections(_sec(spark, sf), ORDER)
    return d.select(*_common(d))


REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "densest_window": (q_densest_window, O.DENSEST_WINDOW),
    "rows_in_window": (q_rows_in_window, O.ROWS_IN_WINDOW),
    "brute_force": (q_brute_force, O.BRUTE_FORCE),
    "credential_spray": (q_credential_spray, O.CREDENTIAL_SPRAY),
    "port_scan": (q_port_scan, O.PORT_SCAN),
    "sequential_ratio": (q_sequential_ratio, O.SEQUENTIAL_RATIO),
    "endpoint_probe": (q_endpoint_probe, O.ENDPOINT_PROBE),
    "suspicious_paths": (q_suspicious_paths, O.SUSPICIOUS_PATHS),
    "all_detections": (q_all_detections, O.ALL_DETECTIONS),
}


# ------------------------------------------------------------------ anomaly / risk / explain / geo
from ..operators import anomaly as A  # noqa: E402
from ..operators.geo import fill_location, geo_lookup  # noqa: E402
from ..operators.risk import ip_event_counts  # noqa: E402
from .analysis import analyse, flat_alerts  # noqa: E402

FIXTURE_MAPPING_CONFIDENCE = 1.0   # the fixture is already canonical: every field pinned


def q_ip_features(spark, sf):
    return A.ip_features(_sec(spark, sf))


def q_ip_zscores(spark, sf):
    z = A.standardize(A.ip_features(_sec(spark, sf)), digits=6)
    return z.select("source_ip", *[f"z_{f}" for f in A.FEATURE_NAMES])


def q_top_features(spark, sf):
    t = A.top_features(A.standardize(A.ip_features(_sec(spark, sf))))
    cols = []
    for i in range(3):
        cols += [F.col("top_features")[i]["feature"].alias(f"feature_{i + 1}"),
                 F.col("top_features")[i]["value"].alias(f"value_{i + 1}")]
    return t.select("source_ip", *cols)


def q_zscore_anomaly(spark, sf):
    return A.zscore_scores(A.standardize(A.ip_features(_sec(spark, sf))))


def q_anomaly_scores(spark, sf):
    return A.anomaly_scores(_sec(spark, sf), "forest").select("source_ip", "anomaly_score")


def q_unknown_anomaly(spark, sf):
    d = analyse(_sec(spark, sf), ORDER, FIXTURE_MAPPING_CONFIDENCE, "forest").detections
    return d.where(F.col("detection_type") == "unknown_anomaly").select(*_common(d))


def q_ip_event_counts(spark, sf):
    return ip_event_counts(_sec(spark, sf))


def _checked(spark, sf):
    return analyse(_sec(spark, sf), ORDER, FIXTURE_MAPPING_CONFIDENCE, "zscore")


RISK_COLS = ["source_ip", "event_count", "threat_severity", "behavior_anomaly", "frequency", "confidence",
             "risk_score", "classification"]


def q_risk_scores(spark, sf):
    return _checked(spark, sf).alerts.select(*RISK_COLS)


def q_candidate_ips(spark, sf):
    return _checked(spark, sf).alerts.select("source_ip")


def q_risk_bands(spark, sf):
    return _checked(spark, sf).alerts.groupBy("classification").agg(F.count(F.lit(1)).alias("alerts"))


def q_explain_threat(spark, sf):
    return _checked(spark, sf).alerts.select("source_ip", "threat")


def q_explain_recommend(spark, sf):
    return _checked(spark, sf).alerts.select("source_ip", F.array_join("recommendation", " | ")
                                             .alias("recommendation"))


def q_explain_evidence(spark, sf):
    return _checked(spark, sf).evidence.select("source_ip", "detector_order", "target", "line")


def q_explain_reason(spark, sf):
    return _checked(spark, sf).alerts.select("source_ip", "reason", "confidence_pct")


def q_geo_join(spark, sf):
    ips = _sec(spark, sf).where(F.col("source_ip").isNotNull()).select("source_ip").distinct()
    return geo_lookup(ips, "source_ip")


def q_location_fill(spark, sf):
    ev = fill_location(_sec(spark, sf).select("event_id", "source_ip"))
    return ev.select("event_id", "source_ip", "source_location")


def q_alerts(spark, sf):
    return flat_alerts(analyse(_sec(spark, sf), ORDER, FIXTURE_MAPPING_CONFIDENCE, "forest").alerts)


REGISTRY.update({
    "ip_features": (q_ip_features, O.IP_FEATURES),
    "ip_zscores": (q_ip_zscores, O.IP_ZSCORES),
    "top_features": (q_top_features, O.TOP_FEATURES),
    "zscore_anomaly": (q_zscore_anomaly, O.ZSCORE_ANOMALY),
    "anomaly_scores": (q_anomaly_scores, None),
    "unknown_anomaly": (q_unknown_anomaly, None),
    "ip_event_counts": (q_ip_event_counts, O.IP_EVENT_COUNTS),
    "candidate_ips": (q_candidate_ips, O.CANDIDATE_IPS),
    "risk_scores": (q_risk_scores, O.RISK_SCORES),
    "risk_bands": (q_risk_bands, O.RISK_BANDS),
    "explain_threat": (q_explain_threat, O.EXPLAIN_THREAT),
    "explain_recommend": (q_explain_recommend, O.EXPLAIN_RECOMMEND),
    "explain_evidence": (q_explain_evidence, O.EXPLAIN_EVIDENCE),
    "explain_reason": (q_explain_reason, O.EXPLAIN_REASON),
    "geo_join": (q_geo_join, O.GEO_JOIN),
    "location_fill": (q_location_fill, O.LOCATION_FILL),
    "alerts": (q_alerts, None),
})


# ------------------------------------------------------------------ serving views
from . import views as V  # noqa: E402
from .analysis import store, stored  # noqa: E402
from .pipeline import _fs  # noqa: E402

ALERT_COLS = ["source_ip", "risk_score", "classification", "threat_severity", "behavior_anomaly", "frequency",
              "confidence", "event_count", "threat"]


_STORED: dict[tuple, str] = {}


def _served(spark, sf):
    """The analysis as stored tables, which is what views are served from.

    The first view of an application over a log writes them to the shared folder; later ones read
    them, as long as they are there and the log's files have not changed.
    """
    fs, events = _fs(spark, f"{sf.rstrip('/')}/events.parquet")
    files = fs.listStatus(events) if fs.getFileStatus(events).isDirectory() else [fs.getFileStatus(events)]
    key = (spark.sparkContext.applicationId, *sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files))
    at = _STORED.get(key)
    if at is None or not _fs(spark, f"{at}/evidence/_SUCCESS")[0].exists(_fs(spark, f"{at}/evidence/_SUCCESS")[1]):
        at = _STORED[key] = _folder(spark, "analysis")
        store(_checked(spark, sf), at)
    return stored(spark, at)


def q_ip_investigation(spark, sf):
    """Q-6: the investigation of one IP, the riskiest; its first events by time and its totals beside each."""
    a, s = _served(spark, sf), _sec(spark, sf)
    worst = V.top_offenders(a.alerts, 1).first()["source_ip"]
    i = V.investigate(s, a.detections, a.alerts, worst, ORDER)
    rank = F.row_number().over(Window.orderBy(F.col("timestamp").asc_nulls_last(), ORDER))   # of at most event_limit rows
    return i.events.select("source_ip", rank.alias("event_rank"), "event_id", "timestamp", F.lit(i.total_events).cast("long").alias("total_events"),
                           F.lit(i.detections.count()).cast("long").alias("detections"))


def q_overview_kpis(spark, sf):
    a = _served(spark, sf)
    return V.overview(_sec(spark, sf), a.detections, a.alerts)


def q_risk_distribution(spark, sf):
    return V.risk_distribution(_served(spark, sf).alerts)


def q_attack_categories(spark, sf):
    return V.attack_categories(_served(spark, sf).detections)


def q_timeline_volume(spark, sf):
    return V.timeline_volume(_sec(spark, sf))


def q_timeline(spark, sf):
    return V.timeline(_sec(spark, sf), _served(spark, sf).detections)


def q_timeline_pivot(spark, sf):
    return V.timeline_pivot(_sec(spark, sf), _served(spark, sf).detections)


def q_alerts_topk(spark, sf):
    return V.alerts_topk(_served(spark, sf).alerts).select(*ALERT_COLS)


def q_top_offenders(spark, sf):
    return V.top_offenders(_served(spark, sf).alerts).select(*ALERT_COLS)


def q_behaviour_anomalies(spark, sf):
    return V.behaviour_anomalies(_served(spark, sf).alerts).select(*ALERT_COLS)


def q_ip_total(spark, sf):
    a = _served(spark, sf)
    return V.ip_totals(_sec(spark, sf), a.detections, a.alerts)


def q_ip_events(spark, sf):
    a = _served(spark, sf)
    e = V.ip_events(_sec(spark, sf), a.alerts, ORDER)
    return e.select("source_ip", "event_rank", "event_id", "timestamp", "event_type", "username", "port",
                    "request_path", "status_code")


def q_attack_progression(spark, sf):
    return V.attack_progression(_served(spark, sf).detections)


def q_geo_distribution(spark, sf):
    return V.geo_distribution(_served(spark, sf).alerts)


def q_peak_risk(spark, sf):
    a = _served(spark, sf)
    return V.peak_risk(a.alerts, a.detections)


REGISTRY.update({
    "overview_kpis": (q_overview_kpis, O.OVERVIEW_KPIS),
    "risk_distribution": (q_risk_distribution, O.RISK_DISTRIBUTION),
    "attack_categories": (q_attack_categories, O.ATTACK_CATEGORIES),
    "timeline_volume": (q_timeline_volume, O.TIMELINE_VOLUME),
    "timeline": (q_timeline, O.TIMELINE),
    "timeline_pivot": (q_timeline_pivot, O.TIMELINE_PIVOT),
    "alerts_topk": (q_alerts_topk, O.ALERTS_TOPK),
    "top_offenders": (q_top_offenders, O.TOP_OFFENDERS),
    "behaviour_anomalies": (q_behaviour_anomalies, O.BEHAVIOUR_ANOMALIES),
    "ip_total": (q_ip_total, O.IP_TOTAL),
    "ip_events": (q_ip_events, O.IP_EVENTS),
    "ip_investigation": (q_ip_investigation, O.IP_INVESTIGATION),
    "attack_progression": (q_attack_progression, O.ATTACK_PROGRESSION),
    "geo_distribution": (q_geo_distribution, O.GEO_DISTRIBUTION),
    "peak_risk": (q_peak_risk, O.PEAK_RISK),
})


# ------------------------------------------------------------------ ingestion / text
from ..functions.rules import failure_indicator  # noqa: E402
from ..functions.timeparse import parse_ts  # noqa: E402
from ..operators import matching as M  # noqa: E402
from ..operators.normalize import mapping_summary, to_number  # noqa: E402
from ..operators.profile import SAMPLE_ROWS, profile  # noqa: E402
from ..operators.textsim import document_tfidf_summary, embedding_concept_match  # noqa: E402
from ..sources.tables import TABLES, read_table  # noqa: E402


def _datasets(spark, sf):
    """The 14 test-data tables plus the security log, as datasets of one catalog."""
    out = [(t, read_table(spark, sf, t)) for t in TABLES]
    out.append(("sec", _sec(spark, sf).withColumnRenamed("event_id", "row_id")))
    return out


def _profiles(spark, sf):
    apply_engine_conf(spark)
    return cut_lineage(profile(_datasets(spark, sf)))     # read by several branches of matching


def q_profile_head(spark, sf):
    """P-1 with its head sample: the first 1 000 rows of the security log."""
    sec = _sec(spark, sf).withColumnRenamed("event_id", "row_id")
    return profile([("sec", sec)], SAMPLE_ROWS).select("column_name", "inferred_dtype", "descriptor")


def q_profile_dtype(spark, sf):
    return _profiles(spark, sf).select("dataset_id", "column_name", "inferred_dtype")


def q_profile_descriptor(spark, sf):
    return _profiles(spark, sf).select("dataset_id", "column_name", "descriptor")


def q_match_assign(spark, sf):
    return M.map_columns(_profiles(spark, sf))


def q_match_scores(spark, sf):
    return M.match_scores(_profiles(spark, sf)).select("dataset_id", "column_name", "concept", "confidence")


def q_mapping_confidence(spark, sf):
    return M.mapping_confidence(M.map_columns(_profiles(spark, sf)))


def q_mapping_review(spark, sf):
    return M.review_list(M.map_columns(_profiles(spark, sf)))


def q_mapping_summary(spark, sf):
    p = _profiles(spark, sf)
    return mapping_summary(M.map_columns(p), p).withColumn("sample_values",
                                                           F.array_join("sample_values", " | "))


def q_ontology(spark, sf):
    """M-15: the ontology listing with its coverage in the security log - for every
    concept, how many events carry a value for that canonical field (whole table)."""
    from ..operators.ontology import KEYS, ontology
    s = _sec(spark, sf)
    present = [k for k in KEYS if k in s.columns]
    counts = s.agg(*[F.count(k).alias(k) for k in present])
    long = counts.select(F.inline(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("events_with_value"))
                                            for k in present])))
    return (ontology(spark).join(long, "key", "left")
            .select("key", "concept_index", "expected_dtype", "display_name", "description",
                    F.coalesce("events_with_value", F.lit(0)).alias("events_with_value")))


def q_tfidf_documents(spark, sf):
    apply_engine_conf(spark)
    return document_tfidf_summary(read_table(spark, sf, "documents"))


def q_embedding_match(spark, sf):
    apply_engine_conf(spark)
    return embedding_concept_match(read_table(spark, sf, "embeddings"))


def q_normalize_numeric(spark, sf):
    s = _sec(spark, sf)
    return s.select("event_id", to_number(F.col("port").cast("string")).alias("port_n"),
                    to_number(F.col("source_ip")).alias("ip_n"),
                    to_number(F.regexp_replace("props", "[^0-9]", "")).alias("props_n"),
                    to_number(F.col("props")).alias("props_raw_n"))


def q_failure_indicator(spark, sf):
    s = _sec(spark, sf)
    return s.select("event_id", failure_indicator(F.col("event_type")).alias("event_type_failed"),
                    failure_indicator(F.col("props")).alias("props_failed"))


def q_normalize_timestamp(spark, sf):
    s = _sec(spark, sf)
    return s.select("event_id", parse_ts(F.col("timestamp").cast("string")).alias("ts_iso"),
                    parse_ts(F.date_format("timestamp", "MM/dd/yyyy hh:mm:ss a")).alias("ts_us"))


REGISTRY.update({
    "profile_head": (q_profile_head, O.PROFILE_HEAD),
    "profile_dtype": (q_profile_dtype, None),
    "profile_descriptor": (q_profile_descriptor, None),
    "match_scores": (q_match_scores, None),
    "match_assign": (q_match_assign, None),
    "mapping_confidence": (q_mapping_confidence, None),
    "mapping_review": (q_mapping_review, None),
    "mapping_summary": (q_mapping_summary, None),
    "ontology": (q_ontology, None),
    "tfidf_documents": (q_tfidf_documents, O.TFIDF_DOCUMENTS),
    "embedding_match": (q_embedding_match, O.EMBEDDING_MATCH),
    "normalize_numeric": (q_normalize_numeric, O.NORMALIZE_NUMERIC),
    "failure_indicator": (q_failure_indicator, O.FAILURE_INDICATOR),
    "normalize_timestamp": (q_normalize_timestamp, O.NORMALIZE_TIMESTAMP),
})


def q_spray_targets(spark, sf):
    return det.spray_targets(_sec(spark, sf), ORDER)


REGISTRY["spray_targets"] = (q_spray_targets, O.SPRAY_TARGETS)


# ------------------------------------------------------------------ ontology / profiling / normalisation (sql)
from ..operators.normalize import to_canonical  # noqa: E402
from ..operators.profile import long_values  # noqa: E402
from .oracle import SEC_COLUMNS  # noqa: E402


def q_profile_sec(spark, sf):
    """P-1 .. P-9 on the security log: head sample, non-null / distinct counts, inferred dtype."""
    sec = _sec(spark, sf).withColumnRenamed("event_id", "row_id")
    p = profile([("sec", sec)])
    lv = long_values([("sec", sec)]).where(F.col("value").isNotNull())
    counts = lv.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_nonnull"),
                                           F.countDistinct("value").alias("n_distinct"))
    return (p.join(counts, "column_name", "left")
             .select("column_name", "col_index", F.coalesce("n_nonnull", F.lit(0)).alias("n_nonnull"),
                     F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"), "inferred_dtype"))


def _sec_as_raw(spark, sf):
    s = _sec(spark, sf)
    return s.select(*[F.col(c).cast("string").alias(c) for c in ["event_id"] + SEC_COLUMNS])


def q_normalize_project(spark, sf):
    raw = _sec_as_raw(spark, sf)
    pairs = [("event_id", None)] + [(c, None if c == "props" else c) for c in SEC_COLUMNS]
    return to_canonical(raw, pairs)


def q_failure_from_event_type(spark, sf):
    raw = _sec_as_raw(spark, sf)
    pairs = [("event_id", None)] + [(c, None if c in ("props", "failed_attempts") else c) for c in SEC_COLUMNS]
    return to_canonical(raw, pairs, keep=["event_id"]).select(F.col("event_id").cast("long").alias("event_id"),
                                                               "failed_attempts")


REGISTRY["ontology"] = (q_ontology, O.ONTOLOGY)
REGISTRY.update({
    "profile_sec": (q_profile_sec, O.PROFILE_SEC),
    "normalize_project": (q_normalize_project, O.NORMALIZE_PROJECT),
    "failure_from_event_type": (q_failure_from_event_type, O.FAILURE_FROM_EVENT_TYPE),
})


def _sec_profile(spark, sf):
    return cut_lineage(profile([("sec", _sec(spark, sf).withColumnRenamed("event_id", "row_id"))]))


def q_profile_sec_descriptor(spark, sf):
    return _sec_profile(spark, sf).select("column_name", "inferred_dtype", "descriptor")


def q_match_scores_sec(spark, sf):
    from ..functions.numfmt import rnd
    s = M.match_scores(_sec_profile(spark, sf))
    return s.select("column_name", "concept", rnd(F.col("sim"), 9).alias("sim"),
                    rnd(F.col("confidence"), 6).alias("confidence"))


def q_match_assign_sec(spark, sf):
    return M.map_columns(_sec_profile(spark, sf))


REGISTRY.update({
    "profile_sec_descriptor": (q_profile_sec_descriptor, O.PROFILE_SEC_DESCRIPTOR),
    "match_scores_sec": (q_match_scores_sec, O.MATCH_SCORES_SEC),
    "match_assign_sec": (q_match_assign_sec, O.MATCH_ASSIGN_SEC),
})


# ------------------------------------------------------------------ readers over a written log
import uuid  # noqa: E402

from ..session import checkpoint_dir  # noqa: E402
from ..sources.logs import read_log  # noqa: E402


def _folder(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def q_read_csv(spark, sf):
    """S-2: the log as CSV files with doubled quotes and commas in a text field; every 50th row has a field too many."""
    s = _sec(spark, sf)
    line = F.concat_ws(",", F.col("event_id").cast("string"), F.concat(F.lit('"he said ""'), "event_type", F.lit('"", ok"')),
                       F.coalesce("username", F.lit("")), F.when(F.col("event_id") % 50 == 0, F.lit("one more")))
    at = _folder(spark, "read-csv")
    s.select(line.alias("event_id,note,username")).write.option("header", True).option("sep", "\u0001").option("quote", "").csv(at)
    return read_log(spark, at, "csv").select(F.col("event_id").cast("long").alias("event_id"), "note", "username")


def q_read_ndjson(spark, sf):
    """S-5: the log as newline-delimited JSON with a line of junk after every 100th record."""
    s = _sec(spark, sf)
    record = F.to_json(F.struct("event_id", "source_ip", "port", "username"))
    lines = F.array_compact(F.array(record, F.when(F.col("event_id") % 100 == 0, F.lit("not json"))))
    at = _folder(spark, "read-ndjson")
    s.select(F.explode(lines).alias("value")).write.text(at)
    return read_log(spark, at, "ndjson").select("event_id", "source_ip", F.col("port").cast("double").alias("port"), "username")


def q_read_csv_quoted(spark, sf):
    """S-2: CSV files in a folder with a blank, half of them in Latin-1, whose text field holds quotes and line breaks."""
    s = _sec(spark, sf)
    note = F.concat(F.lit('\u00e9 "'), "event_type", F.lit('",\nok')).alias("note")
    at = f"{_folder(spark, 'read csv')}/a b"
    for part, encoding in ((0, "UTF-8"), (1, "ISO-8859-1")):
        half = s.where(F.col("event_id") % 2 == part).select("event_id", note, "username")
        half.write.mode("append").option("header", True).option("escape", '"').option("encoding", encoding).csv(at)
    return read_log(spark, at, "csv").select(F.col("event_id").cast("long").alias("event_id"), "note", "username")


def q_read_ndjson_escapes(spark, sf):
    """S-5: newline-delimited JSON whose records hold escaped quotes, brackets and backslashes."""
    s = _sec(spark, sf)
    msg = F.concat(F.lit('say "[" to {'), "event_type", F.lit('\\"}]')).alias("msg")
    at = _folder(spark, "read-escapes")
    s.select(F.to_json(F.struct("event_id", msg, "port"))).write.text(at)
    return read_log(spark, at, "ndjson").select("event_id", "msg", F.col("port").cast("double").alias("port"))


WRAPPED_ROWS = 1000


def q_read_wrapped_json(spark, sf):
    """S-4 / S-6 / S-7: the log as many JSON documents, a thousand records each, under three different wrappers."""
    s = _sec(spark, sf)
    record = F.to_json(F.struct("event_id", "source_ip", F.struct("port", F.col("username").alias("user")).alias("net")))
    doc = F.col("event_id").cast("long") - F.pmod(F.col("event_id").cast("long"), F.lit(WRAPPED_ROWS))
    docs = s.groupBy(doc.alias("doc")).agg(F.array_join(F.collect_list(record), ",\n").alias("r"))
    kind = F.pmod(F.col("doc") / WRAPPED_ROWS, F.lit(3)).cast("int")
    text = (F.when(kind == 0, F.concat(F.lit('{"took": 3, "hits": {"total": 9, "hits": [\n'), "r", F.lit("\n]}}")))
             .when(kind == 1, F.concat(F.lit('{"Records": ['), "r", F.lit('], "meta": [{"k": 1}]}')))
             .otherwise(F.concat(F.lit('{\n"value": {"items": [{"x": "["}, 1], "rows": ['), "r", F.lit("]}\n}"))))
    at = _folder(spark, "read-wrapped")
    docs.select(text.alias("value")).write.option("maxRecordsPerFile", 1).text(at)
    return read_log(spark, at, "json").select("event_id", "source_ip", F.col("`net.port`").cast("double").alias("net_port"),
                                              F.col("`net.user`").alias("net_user"))


def q_embedding_cosine(spark, sf):
    """M-2: columns against concepts by vectors, at the embedder's temperature. Every vector of the table
    stands for a text column of one dataset, and the first 13 vectors for the concepts."""
    from ..functions.numfmt import rnd
    from ..operators.ontology import KEYS
    from ..operators.textsim import cosine_similarity
    apply_engine_conf(spark)
    emb = read_table(spark, sf, "embeddings")
    columns = emb.select(F.lit("emb").alias("dataset_id"), F.concat(F.lit("c"), "vec_id").alias("column_name"),
                         F.col("vec_id").cast("int").alias("col_index"), F.lit("string").alias("inferred_dtype"),
                         F.col("embedding").alias("vector"))
    key = F.create_map(*[F.lit(x) for i, k in enumerate(KEYS) for x in (i, k)])
    concepts = emb.where(F.col("vec_id") < len(KEYS)).select(key[F.col("vec_id").cast("int")].alias("concept"), F.col("embedding").alias("vector"))
    scores = M.match_scores(columns, M.EMBEDDING_TEMPERATURE, cosine_similarity(columns, concepts))
    return scores.select("column_name", "concept", rnd(F.col("sim"), 6).alias("sim"), rnd(F.col("confidence"), 6).alias("confidence"))


def q_match_override(spark, sf):
    """M-8: the security log's columns with two analyst decisions."""
    return M.map_columns(_sec_profile(spark, sf), {"sec": {"port": None, "props": "source_location"}})


def q_match_single_ip(spark, sf):
    """M-9: a log whose only address column has no telling name."""
    s = _sec(spark, sf).select(F.col("event_id").alias("row_id"), F.col("source_ip").alias("rhost"), F.col("username").alias("user"),
                               F.col("event_type").alias("result"))
    return M.map_columns(cut_lineage(profile([("lone", s)])))


REGISTRY.update({
    "read_csv": (q_read_csv, O.READ_CSV),
    "read_ndjson": (q_read_ndjson, O.READ_NDJSON),
    "read_csv_quoted": (q_read_csv_quoted, O.READ_CSV_QUOTED),
    "read_ndjson_escapes": (q_read_ndjson_escapes, O.READ_NDJSON_ESCAPES),
    "read_wrapped_json": (q_read_wrapped_json, O.READ_WRAPPED_JSON),
    "embedding_cosine": (q_embedding_cosine, O.EMBEDDING_COSINE),
    "match_override": (q_match_override, O.MATCH_OVERRIDE),
    "match_single_ip": (q_match_single_ip, O.MATCH_SINGLE_IP),
})


# ------------------------------------------------------------------ profiles, mappings and unmapped fields of the security log
def q_profile_long(spark, sf):
    """P-2: the security log as one row per cell."""
    cells = long_values([("sec", _sec(spark, sf).withColumnRenamed("event_id", "row_id"))])
    return cells.select("column_name", "col_index", "row_id", "value")


def q_profile_shape(spark, sf):
    """P-10 / P-11: the first distinct values of every column and the sentence on their shape."""
    shape = F.expr("substr(descriptor, instr(descriptor, 'Inferred type: ') + length(concat('Inferred type: ', inferred_dtype, '. ')))")
    samples = F.when(F.size("sample_values") > 0, F.array_join("sample_values", " | "))
    return _sec_profile(spark, sf).select("column_name", "inferred_dtype", samples.alias("samples"), shape.alias("shape"))


def q_mapping_summary_sec(spark, sf):
    p = _sec_profile(spark, sf)
    return mapping_summary(M.map_columns(p), p).withColumn("sample_values", F.array_join("sample_values", " | "))


def q_mapping_confidence_sec(spark, sf):
    from ..functions.numfmt import rnd
    return M.mapping_confidence(M.map_columns(_sec_profile(spark, sf))).withColumn("avg_confidence", rnd(F.col("avg_confidence"), 6))


def q_mapping_review_sec(spark, sf):
    return M.review_list(M.map_columns(_sec_profile(spark, sf))).select("column_name", "mapped_field", "confidence")


def q_override_diff(spark, sf):
    """M-14: what the two analyst decisions of ``match_override`` change."""
    scores = cut_lineage(M.match_scores(_sec_profile(spark, sf)))    # read by both assignments
    return M.override_diff(M.assign(scores), M.assign(scores, {"sec": {"port": None, "props": "source_location"}}))


def q_extra_fields(spark, sf):
    """N-7: unmapped columns of several types, nested ones and names with dots and blanks included, as JSON per row."""
    raw = _sec(spark, sf).select("source_ip", "event_id", (F.col("port") == 22).alias("is ssh"), (F.col("status_code") / 8).alias("share"),
                                 F.col("username").alias("user.name"), F.struct("port", F.array("device_id", "destination_ip").alias("hosts")).alias("net"))
    return to_canonical(raw, [(c, "source_ip" if c == "source_ip" else None) for c in raw.columns]).select("source_ip", "extra_fields")


REGISTRY.update({
    "profile_dtype": (q_profile_dtype, O.PROFILE_DTYPE),
    "profile_long": (q_profile_long, O.PROFILE_LONG),
    "profile_shape": (q_profile_shape, O.PROFILE_SHAPE),
    "mapping_summary_sec": (q_mapping_summary_sec, O.MAPPING_SUMMARY_SEC),
    "mapping_confidence_sec": (q_mapping_confidence_sec, O.MAPPING_CONFIDENCE_SEC),
    "mapping_review_sec": (q_mapping_review_sec, O.MAPPING_REVIEW_SEC),
    "override_diff": (q_override_diff, O.OVERRIDE_DIFF),
    "extra_fields": (q_extra_fields, O.EXTRA_FIELDS),
})
