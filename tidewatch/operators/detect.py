"""Rule-based detectors over the canonical event table (D-1 .. D-9).

The rules run together, whichever of them are asked for. A row of the log is
tagged with the rules it counts for, and one window chain (:mod:`.windows`)
finds the densest window of every (rule, source, target), each rule with its
width. Windows with too few rows to fire go; what is left is small and is
stored. One join brings the rows inside the windows back, which become one row
per distinct value (user, port, host, path) of a window; statistics, port
gaps and first-ten lists are one window and one aggregate over those.

Output rows share one schema (:data:`DETECTION_COLUMNS`); the per-type evidence
sits in one struct whose unused fields are null (``to_json`` drops them at the
sink).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import is_error_status, is_suspicious_path
from ..session import cut_lineage
from .windows import densest_window, rows_in_window

# ---- fixed values: windows and thresholds of the rules --------------------
BRUTE_FORCE_WINDOW_MIN = 10
BRUTE_FORCE_THRESHOLD = 8
SPRAY_WINDOW_MIN = 10
SPRAY_USER_THRESHOLD = 8
PORT_SCAN_WINDOW_MIN = 5
PORT_SCAN_THRESHOLD = 15
SEQUENTIAL_GAP = 3
SEQUENTIAL_FLAG_RATIO = 0.6
PROBE_WINDOW_MIN = 10
PROBE_PATH_THRESHOLD = 10
PROBE_ERROR_RATIO = 0.5
PROBE_SUSPICIOUS_THRESHOLD = 5
SAMPLE_LIST_SIZE = 10
# Inferred (the spraying rule is not in the studied snapshot): a spray is many
# users with few tries each; severity saturates at three times the user threshold.
SPRAY_MAX_AVG_ATTEMPTS = 3.0
# ---------------------------------------------------------------------------

DETECTOR_ORDER = {"brute_force": 0, "credential_spray": 1, "port_scan": 2,
                  "endpoint_probe": 3, "unknown_anomaly": 4}

EVIDENCE_FIELDS = [
    ("failed_attempts_in_window", "bigint"), ("target_username", "string"),
    ("distinct_usernames_targeted", "bigint"), ("total_failed_attempts", "bigint"),
    ("avg_attempts_per_user", "double"),
    ("distinct_ports_contacted", "bigint"), ("target_hosts", "array<string>"),
    ("sequential_pattern", "boolean"), ("sequential_ratio", "double"),
    ("distinct_paths_requested", "bigint"), ("error_response_ratio", "double"),
    ("suspicious_path_hits", "bigint"), ("sample_paths", "array<string>"),
    ("anomaly_score", "double"),
    ("deviating_features", "array<struct<feature:string,value:double>>"),
    ("note", "string"),
    ("window_minutes", "double"),
]

DETECTION_COLUMNS = ["detection_type", "detector_order", "source_ip", "window_start", "window_end",
                     "severity", "event_count", "targeted_usernames", "evidence"]


def evidence(**given: Column) -> Column:
    """The shared evidence struct; fields not given are typed nulls."""
    parts = []
    for name, typ in EVIDENCE_FIELDS:
        c = given.pop(name, None)
        parts.append((c if c is not None else F.lit(None)).cast(typ).alias(name))
    if given:
        raise ValueError(f"unknown evidence fields: {sorted(given)}")
    return F.struct(*parts)


def _detection(kind: str, source_ip: Column, start: Column, end: Column, severity: Column,
               event_count: Column, targeted: Column | None, ev: Column) -> list[Column]:
    return [F.lit(kind).alias("detection_type"), F.lit(DETECTOR_ORDER[kind]).alias("detector_order"),
            source_ip.alias("source_ip"), start.alias("window_start"), end.alias("window_end"),
            severity.cast("double").alias("severity"), event_count.cast("long").alias("event_count"),
            (targeted if targeted is not None else F.array().cast("array<string>")).alias("targeted_usernames"),
            ev.alias("evidence")]


def has_any(df: DataFrame, col: str) -> bool:
    """Dataset-level flag: does ``col`` hold any non-null value? (a short job that
    stops at the first hit)."""
    return len(df.where(F.col(col).isNotNull()).select(col).limit(1).collect()) > 0


def _failed() -> Column:
    return F.coalesce(F.col("failed_attempts"), F.lit(0.0)) >= 1


# ---------------------------------------------------------------- windows of all rules
BRUTE, SPRAY, SCAN, PROBE = (DETECTOR_ORDER[k] for k in ("brute_force", "credential_spray", "port_scan", "endpoint_probe"))
RULES = (BRUTE, SPRAY, SCAN, PROBE)
WIDTH_MIN = {BRUTE: BRUTE_FORCE_WINDOW_MIN, SPRAY: SPRAY_WINDOW_MIN, SCAN: PORT_SCAN_WINDOW_MIN, PROBE: PROBE_WINDOW_MIN}
#: A window of fewer rows can't fire: distinct values and hits are no more than rows.
LEAST_ROWS = {BRUTE: BRUTE_FORCE_THRESHOLD, SPRAY: SPRAY_USER_THRESHOLD, SCAN: PORT_SCAN_THRESHOLD,
              PROBE: min(PROBE_PATH_THRESHOLD, PROBE_SUSPICIOUS_THRESHOLD)}


def _by_rule(values: dict[int, object], rules) -> Column:
    """The rule's value, of the rules in use."""
    out = F.lit(values[rules[-1]])
    for r in rules[:-1]:
        out = F.when(F.col("rule") == r, F.lit(values[r])).otherwise(out)
    return out


def _usable(df: DataFrame) -> DataFrame:
    return df.where(F.col("source_ip").isNotNull() & F.col("timestamp").isNotNull())


def _tags(rules, has_users: bool) -> Column:
    """The rules a row counts for, as (rule, target); only brute force looks at each target by itself."""
    failed, user = _failed(), F.col("username")
    counts = {BRUTE: failed & user.isNotNull() if has_users else failed, SPRAY: failed & user.isNotNull(),
              SCAN: F.col("port").isNotNull(), PROBE: F.col("request_path").isNotNull()}
    none = F.lit(None).cast("string")
    tag = lambda r: F.struct(F.lit(r).alias("rule"), (user if r == BRUTE and has_users else none).alias("target"))
    return F.array_compact(F.array(*[F.when(counts[r], tag(r)) for r in rules]))


def _windows(df: DataFrame, rules, bucket_minutes: int | None) -> DataFrame:
    """rule, source_ip, target and the densest window of each that has rows enough to fire."""
    tagged = _usable(df).select("source_ip", "timestamp", F.inline(_tags(rules, BRUTE in rules and has_any(df, "username"))))
    win = densest_window(tagged, ["rule", "source_ip", "target"], "timestamp", max(WIDTH_MIN[r] for r in rules),
                         bucket_minutes, _by_rule(WIDTH_MIN, rules), _by_rule(LEAST_ROWS, rules))
    return win.where(F.col("window_count") >= _by_rule(LEAST_ROWS, rules))


# ---------------------------------------------------------------- D-1
def _brute_force(win: DataFrame) -> DataFrame:
    n = F.col("window_count")
    return win.where(F.col("rule") == BRUTE).select(*_detection(
        "brute_force", F.col("source_ip"), F.col("window_start"), F.col("window_end"),
        F.least(F.lit(1.0), n / F.lit(3.0 * BRUTE_FORCE_THRESHOLD)), n,
        F.when(F.col("target").isNotNull(), F.array(F.col("target"))).otherwise(F.array().cast("array<string>")),
        evidence(failed_attempts_in_window=n,
                 target_username=F.coalesce(F.col("target"), F.lit("unattributed")),
                 window_minutes=F.lit(float(BRUTE_FORCE_WINDOW_MIN)))))


# ---------------------------------------------------------------- D-3 / D-4
def port_gaps(ports: DataFrame, group: list[str], port: str) -> DataFrame:
    """Per group of distinct ports (rows): ``n_ports`` and the share of neighbour gaps <= 3 (< 2 ports: 0).

    The ports of a group stream through a lag; no list of them is built.
    """
    before = F.lag(port).over(Window.partitionBy(*group).orderBy(port))
    g = ports.withColumn("_close", (F.col(port) - before) <= SEQUENTIAL_GAP).groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_ports"), F.count_if("_close").alias("_c"))
    ratio = F.when(F.col("n_ports") < 2, F.lit(0.0)).otherwise(F.col("_c") / (F.col("n_ports") - 1).cast("double"))
    return g.select(*group, "n_ports", ratio.alias("sequential_ratio"))


# ---------------------------------------------------------------- D-2 .. D-7
_USER, _PORT, _HOST, _PATH = range(4)
_SLICES = 16


def _values(df: DataFrame, win: DataFrame, rules, order_col: str, bucket_minutes: int | None) -> DataFrame:
    """One row per distinct value inside a window: rule, kind, value, port, n rows, errors, first row."""
    rows = _usable(df).select("source_ip", "timestamp", "username", F.col("port").cast("long").alias("port"), "destination_ip",
                              "request_path", "status_code", order_col, F.inline(_tags(rules, False)))
    keys = ["rule", "source_ip"]
    inside = rows_in_window(rows, win.select(*keys, "window_start", "window_end"), keys, "timestamp",
                            max(WIDTH_MIN[r] for r in rules), bucket_minutes)
    none = F.lit(None).cast("long")
    value = lambda kind, c, port=none: F.struct(F.lit(kind).alias("kind"), c.cast("string").alias("value"), port.alias("port"))
    found = (F.when(F.col("rule") == SPRAY, F.array(value(_USER, F.col("username"))))
              .when(F.col("rule") == PROBE, F.array(value(_PATH, F.col("request_path"))))
              .otherwise(F.array_compact(F.array(value(_PORT, F.col("port"), F.col("port")),
                                                 F.when(F.col("destination_ip").isNotNull(), value(_HOST, F.col("destination_ip")))))))
    error = is_error_status(F.col("status_code")).cast("int")
    each = inside.select(*keys, "window_start", "window_end", error.alias("error"), F.col(order_col).alias("_o"), F.inline(found))
    return each.groupBy(*keys, "window_start", "window_end", "kind", "value", "port").agg(
        F.count(F.lit(1)).alias("n"), F.sum("error").alias("errors"), F.min("_o").alias("first"))


def _statistics(values: DataFrame) -> DataFrame:
    """Per window: distinct values, rows, errors, sensitive hits, close port neighbours, and the first ten values.

    The ports of a window are at most 65 536 and are ordered together; other values are ranked in
    slices, whose first ten hold the window's.
    """
    key = ["rule", "source_ip", "window_start", "window_end"]
    part = F.when(F.col("kind") == _PORT, 0).otherwise(F.pmod(F.xxhash64("value"), F.lit(_SLICES)))
    order = Window.partitionBy(*key, "kind", part).orderBy("port", "first", "value")
    v = values.withColumn("rank", F.row_number().over(order)).withColumn("close", F.col("port") - F.lag("port").over(order) <= SEQUENTIAL_GAP)
    own = F.col("kind") != _HOST
    listed = (F.col("kind") != _PORT) & (F.col("rank") <= SAMPLE_LIST_SIZE)
    sample = F.array_sort(F.collect_list(F.when(listed, F.struct("first", "value"))))
    return v.groupBy(*key).agg(
        F.count_if(own).alias("distinct"), F.sum(F.when(own, F.col("n"))).alias("rows"),
        F.sum(F.when(own, F.col("errors"))).alias("errors"),
        F.coalesce(F.sum(F.when((F.col("kind") == _PATH) & is_suspicious_path(F.col("value")), F.col("n"))), F.lit(0)).alias("hits"),
        F.count_if("close").alias("close"),
        F.transform(F.slice(sample, 1, SAMPLE_LIST_SIZE), lambda x: x["value"]).alias("sample"))


def _value_rules(stats: DataFrame, max_avg_attempts: float) -> DataFrame:
    """The detections of spraying, scanning and probing."""
    is_spray, is_scan, is_probe = (F.col("rule") == r for r in (SPRAY, SCAN, PROBE))
    n, rows, hits = F.col("distinct"), F.col("rows"), F.col("hits")
    avg = rows / n
    seq = F.when(n < 2, 0.0).otherwise(F.col("close") / (n - 1).cast("double"))
    err = F.col("errors") / rows.cast("double")
    fires = ((is_spray & (n >= SPRAY_USER_THRESHOLD) & (avg <= F.lit(max_avg_attempts)))
             | (is_scan & (n >= PORT_SCAN_THRESHOLD))
             | (is_probe & (((n >= PROBE_PATH_THRESHOLD) & (err >= PROBE_ERROR_RATIO)) | (hits >= PROBE_SUSPICIOUS_THRESHOLD))))
    full = {SPRAY: 3.0 * SPRAY_USER_THRESHOLD, SCAN: 3.0 * PORT_SCAN_THRESHOLD, PROBE: 3.0 * PROBE_PATH_THRESHOLD}
    many = F.least(F.lit(1.0), n / _by_rule(full, (SPRAY, SCAN, PROBE)))
    severity = F.when(is_probe, F.greatest(many, F.least(F.lit(1.0), hits / F.lit(3.0 * PROBE_SUSPICIOUS_THRESHOLD)))).otherwise(many)
    nobody = F.array().cast("array<string>")
    names = {r: k for k, r in DETECTOR_ORDER.items()}
    return stats.where(fires).select(
        _by_rule(names, (SPRAY, SCAN, PROBE)).alias("detection_type"), F.col("rule").alias("detector_order"), "source_ip",
        "window_start", "window_end", severity.cast("double").alias("severity"), rows.cast("long").alias("event_count"),
        F.when(is_spray, F.col("sample")).otherwise(nobody).alias("targeted_usernames"),
        evidence(distinct_usernames_targeted=F.when(is_spray, n), total_failed_attempts=F.when(is_spray, rows),
                 avg_attempts_per_user=F.when(is_spray, F.round(avg, 2)),
                 distinct_ports_contacted=F.when(is_scan, n), target_hosts=F.when(is_scan, F.col("sample")),
                 sequential_pattern=F.when(is_scan, seq >= SEQUENTIAL_FLAG_RATIO), sequential_ratio=F.when(is_scan, F.round(seq, 2)),
                 distinct_paths_requested=F.when(is_probe, n), error_response_ratio=F.when(is_probe, F.round(err, 2)),
                 suspicious_path_hits=F.when(is_probe, hits), sample_paths=F.when(is_probe, F.col("sample")),
                 window_minutes=_by_rule({r: float(WIDTH_MIN[r]) for r in RULES}, (SPRAY, SCAN, PROBE))).alias("evidence"))


# ---------------------------------------------------------------- D-8
def rule_detections(df: DataFrame, order_col: str = "row_id", bucket_minutes: int | None = None,
                    rules=RULES, max_avg_attempts: float = SPRAY_MAX_AVG_ATTEMPTS) -> DataFrame:
    """The detections of ``rules``. No usable source IP -> no rows.

    The log is read once for the windows and once for the rows inside them, whatever the number of rules.
    """
    win = _windows(df, rules, bucket_minutes)
    valued = tuple(r for r in rules if r != BRUTE)
    if not valued:
        return _brute_force(win)
    win = cut_lineage(win)      # read by the join and by brute force
    inside = _values(df, win.where(F.col("rule") != BRUTE), valued, order_col, bucket_minutes)
    found = _value_rules(_statistics(inside), max_avg_attempts)
    return _brute_force(win).unionByName(found) if BRUTE in rules else found


def brute_force(df: DataFrame, bucket_minutes: int | None = None) -> DataFrame:
    """D-1: many failures against one (source IP, username) inside 10 minutes.

    Keyed by (ip, username) when the dataset has any username (failures without
    one are then skipped), else by ip alone with target ``unattributed``.
    """
    return rule_detections(df, bucket_minutes=bucket_minutes, rules=(BRUTE,))


def credential_spray(df: DataFrame, order_col: str = "row_id", bucket_minutes: int | None = None,
                     max_avg_attempts: float = SPRAY_MAX_AVG_ATTEMPTS) -> DataFrame:
    """D-2: failures from one source IP spread over many usernames inside 10 minutes.

    Stands down (no rows) without usernames. ``targeted_usernames`` carries the
    first 10 accounts in input order; :func:`spray_targets` gives the full list
    as rows.
    """
    return rule_detections(df, order_col, bucket_minutes, (SPRAY,), max_avg_attempts)


def port_scan(df: DataFrame, order_col: str = "row_id", bucket_minutes: int | None = None) -> DataFrame:
    """D-3 / D-4: one source IP touching many distinct ports inside 5 minutes."""
    return rule_detections(df, order_col, bucket_minutes, (SCAN,))


def endpoint_probe(df: DataFrame, order_col: str = "row_id", bucket_minutes: int | None = None) -> DataFrame:
    """D-5 .. D-7: many distinct paths with mostly error responses, or repeated sensitive paths,
    from one source IP inside 10 minutes."""
    return rule_detections(df, order_col, bucket_minutes, (PROBE,))


def spray_targets(df: DataFrame, order_col: str = "row_id", bucket_minutes: int | None = None,
                  detections: DataFrame | None = None) -> DataFrame:
    """Every (source_ip, username) targeted inside a spray window, with its first row.

    ``detections`` (stored ones) saves finding the windows again.
    """
    if detections is None:
        detections = credential_spray(df, order_col, bucket_minutes)
    spray = detections.where(F.col("detection_type") == "credential_spray").select("source_ip", "window_start", "window_end")
    failed = _usable(df).where(_failed() & F.col("username").isNotNull())
    inside = rows_in_window(failed.select("source_ip", "timestamp", "username", order_col), spray,
                            ["source_ip"], "timestamp", SPRAY_WINDOW_MIN, bucket_minutes)
    return inside.groupBy("source_ip", "username").agg(F.min(order_col).alias("first_row"))
