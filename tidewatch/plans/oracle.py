"""DuckDB twins of the registered queries (the correctness oracle).

Each function returns ANSI SQL over the pre-registered test-data views; the
``sec`` fixture is inlined as a CTE. The fragments below are the spec the
Spark plans are checked against: plain per-row window frames and joins,
written for clarity, not speed.
"""

from __future__ import annotations

from ..sources.fixture import SEC_DUCKDB_SQL

D = "::double"
# Written out here and not imported, so that a wrong constant in a plan shows.
FAILURE_PATTERN = "fail|denied|invalid|error|reject|refus|unauthor|forbidden|lock|bad"
SUSPICIOUS_PATH_PATTERNS = ["admin", ".env", "wp-login", "phpmyadmin", ".git", "passwd", "shadow", ".bak", "debug", "..",
                            "server-status", "actuator"]
ERROR_IN = "400.0, 401.0, 403.0, 404.0, 500.0"
TOKEN = r"[\p{L}\p{N}_]{2,}"
NUMBER_TEXT = PROFILE_NUMBER = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"
INTEGER_TEXT = r"^-?\d+$"
DATE_SHAPE = (r"(\d{4}[-/]\d{1,2}[-/]\d{1,2})|(\d{1,2}[-/]\d{1,2}[-/]\d{4})|(\d{1,2}/[A-Za-z]{3}/\d{4})"
              r"|([A-Za-z]{3} \d{1,2},? \d{4})|(\d{1,2} [A-Za-z]{3} \d{4})|(^\d{8}T\d{6})")


def ctes(*parts: str) -> str:
    return "with sec as (" + SEC_DUCKDB_SQL + ")" + "".join(",\n" + p for p in parts) + "\n"


def densest(name: str, src: str, keys: str, minutes: int, min_count: int = 1) -> str:
    """CTE ``name`` with keys, n, window_start, window_end of each group's densest window."""
    return f"""{name}_c as (
  select {keys}, timestamp as window_end,
         count(*) over w as n, min(timestamp) over w as window_start
  from {src}
  window w as (partition by {keys} order by timestamp range between interval {minutes} minutes preceding and current row)),
{name} as (
  select {keys}, n, window_start, window_end from (
    select *, row_number() over (partition by {keys} order by n desc, window_end asc) as rn from {name}_c)
  where rn = 1 and n >= {min_count})"""


def first_k(name: str, src: str, key: str, value: str, k: int = 10) -> str:
    return f"""{name} as (
  select {key}, string_agg({value}, ',' order by fo, {value}) as {name}_list from (
    select {key}, {value}, min(event_id) as fo,
           row_number() over (partition by {key} order by min(event_id), {value}) as rn
    from {src} where {value} is not null group by {key}, {value})
  where rn <= {k} group by {key})"""


FAILED = "coalesce(failed_attempts, 0) >= 1"
SUSPICIOUS = "(" + " or ".join(f"contains(lower(request_path), '{p}')" for p in SUSPICIOUS_PATH_PATTERNS) + ")"

BF_SRC = f"""bf_src as (
  select source_ip, username, timestamp from sec
  where {FAILED} and source_ip is not null and timestamp is not null
    and (username is not null or not exists (select 1 from sec where username is not null)))"""

BRUTE_FORCE = ctes(BF_SRC, densest("bf", "bf_src", "source_ip, username", 10, 8)) + f"""
select 'brute_force' as detection_type, source_ip, coalesce(username, 'unattributed') as target_username,
       window_start, window_end, least(1.0{D}, n / 24.0{D}) as severity, n as event_count,
       n as failed_attempts_in_window, 10.0{D} as window_minutes
from bf"""

CS_SRC = f"""cs_src as (
  select event_id, source_ip, username, timestamp from sec
  where {FAILED} and source_ip is not null and timestamp is not null and username is not null)"""
CS_BODY = [CS_SRC, densest("cs_w", "cs_src", "source_ip", 10, 8),
           """cs_in as (select s.*, w.window_start, w.window_end from cs_src s join cs_w w using (source_ip)
  where s.timestamp between w.window_start and w.window_end)""",
           """cs_st as (select source_ip, window_start, window_end, count(distinct username) as users,
  count(*) as attempts from cs_in group by all)""",
           "cs_hit as (select * from cs_st where users >= 8 and attempts / users::double <= 3.0)",
           first_k("cs_tg", "cs_in", "source_ip", "username")]
CREDENTIAL_SPRAY = ctes(*CS_BODY) + f"""
select 'credential_spray' as detection_type, h.source_ip, window_start, window_end,
       least(1.0{D}, users / 24.0{D}) as severity, attempts as event_count,
       users as distinct_usernames_targeted, attempts as total_failed_attempts,
       round(attempts / users{D}, 2) as avg_attempts_per_user,
       coalesce(cs_tg_list, '') as targeted_usernames, 10.0{D} as window_minutes
from cs_hit h left join cs_tg using (source_ip)"""

PS_BODY = ["""ps_src as (select event_id, source_ip, timestamp, cast(trunc(port) as bigint) as port_i, destination_ip
  from sec where source_ip is not null and timestamp is not null and port is not null)""",
           densest("ps_w", "ps_src", "source_ip", 5, 15),
           """ps_in as (select s.*, w.window_start, w.window_end from ps_src s join ps_w w using (source_ip)
  where s.timestamp between w.window_start and w.window_end)""",
           """ps_st as (select source_ip, window_start, window_end, count(distinct port_i) as n_ports, count(*) as rows
  from ps_in group by all having count(distinct port_i) >= 15)""",
           """ps_gap as (select source_ip, port_i - lag(port_i) over (partition by source_ip order by port_i) as gap
  from (select distinct source_ip, port_i from ps_in))""",
           """ps_seq as (select source_ip, case when count(*) < 2 then 0.0
  else count(*) filter (where gap <= 3) / (count(*) - 1)::double end as seq from ps_gap group by source_ip)""",
           first_k("ps_tg", "ps_in", "source_ip", "destination_ip")]
PORT_SCAN = ctes(*PS_BODY) + f"""
select 'port_scan' as detection_type, source_ip, window_start, window_end,
       least(1.0{D}, n_ports / 45.0{D}) as severity, rows as event_count,
       n_ports as distinct_ports_contacted, coalesce(ps_tg_list, '') as target_hosts,
       seq >= 0.6 as sequential_pattern, round(seq, 2) as sequential_ratio, 5.0{D} as window_minutes
from ps_st join ps_seq using (source_ip) left join ps_tg using (source_ip)"""

EP_BODY = ["""ep_src as (select event_id, source_ip, timestamp, request_path, status_code
  from sec where source_ip is not null and timestamp is not null and request_path is not null)""",
           densest("ep_w", "ep_src", "source_ip", 10, 5),
           """ep_in as (select s.*, w.window_start, w.window_end from ep_src s join ep_w w using (source_ip)
  where s.timestamp between w.window_start and w.window_end)""",
           f"""ep_st as (select source_ip, window_start, window_end, count(distinct request_path) as paths,
  avg(case when status_code in ({ERROR_IN}) then 1.0 else 0.0 end){D} as err,
  count(*) filter (where {SUSPICIOUS}) as hits, count(*) as rows from ep_in group by all)""",
           "ep_hit as (select * from ep_st where (paths >= 10 and err >= 0.5) or hits >= 5)",
           first_k("ep_tg", "ep_in", "source_ip", "request_path")]
ENDPOINT_PROBE = ctes(*EP_BODY) + f"""
select 'endpoint_probe' as detection_type, source_ip, window_start, window_end,
       greatest(least(1.0{D}, paths / 30.0{D}), least(1.0{D}, hits / 15.0{D})) as severity, rows as event_count,
       paths as distinct_paths_requested, round(err, 2) as error_response_ratio, hits as suspicious_path_hits,
       coalesce(ep_tg_list, '') as sample_paths, 10.0{D} as window_minutes
from ep_hit left join ep_tg using (source_ip)"""

# densest failed-event window of every source IP (no threshold)
DENSEST_WINDOW = ctes(f"""dw_src as (select source_ip, timestamp from sec
  where {FAILED} and source_ip is not null and timestamp is not null)""",
                      densest("dw", "dw_src", "source_ip", 10)) + """
select source_ip, n as window_count, window_start, window_end from dw"""

ROWS_IN_WINDOW = ctes(f"""dw_src as (select event_id, source_ip, timestamp from sec
  where {FAILED} and source_ip is not null and timestamp is not null)""",
                      densest("dw", "dw_src", "source_ip", 10)) + """
select s.event_id, s.source_ip, s.timestamp, w.window_start, w.window_end
from dw_src s join dw w using (source_ip) where s.timestamp between w.window_start and w.window_end"""

SEQUENTIAL_RATIO = ctes("""sr_p as (select distinct source_ip, cast(trunc(port) as bigint) as port_i from sec
  where source_ip is not null and port is not null)""",
                        """sr_g as (select source_ip, port_i - lag(port_i) over (partition by source_ip order by port_i) as gap
  from sr_p)""") + """
select source_ip, count(*) as n_ports,
       case when count(*) < 2 then 0.0 else count(*) filter (where gap <= 3) / (count(*) - 1)::double end
         as sequential_ratio
from sr_g group by source_ip"""

SUSPICIOUS_PATHS = ctes() + f"""
select request_path, count(*) as hits, {SUSPICIOUS} as suspicious
from sec where request_path is not null group by request_path"""

ALL_DETECTIONS = ctes(BF_SRC, densest("bf", "bf_src", "source_ip, username", 10, 8), *CS_BODY, *PS_BODY,
                      *EP_BODY) + f"""
select 'brute_force' as detection_type, source_ip, window_start, window_end, least(1.0{D}, n / 24.0{D}) as severity,
       n as event_count from bf
union all
select 'credential_spray', source_ip, window_start, window_end, least(1.0{D}, users / 24.0{D}), attempts from cs_hit
union all
select 'port_scan', source_ip, window_start, window_end, least(1.0{D}, n_ports / 45.0{D}), rows from ps_st
union all
select 'endpoint_probe', source_ip, window_start, window_end,
       greatest(least(1.0{D}, paths / 30.0{D}), least(1.0{D}, hits / 15.0{D})), rows from ep_hit"""

FAILURE_PATTERN_SQL = FAILURE_PATTERN


# ------------------------------------------------------------------ anomaly / risk / explain
from ..operators.anomaly import FEATURE_NAMES, UNKNOWN_NOTE  # noqa: E402
from ..operators.explain import (BASELINE_LINE, MULTIPLE_PREFIX, NO_RULE_THREAT, REASON_BEHAVIOUR,  # noqa: E402
                                 REASON_LOW, REASON_PREFIX, REASON_RULE, REASON_VOLUME, RECOMMENDATIONS,
                                 THREAT_LABELS)
from ..operators.geo import geo_values_sql  # noqa: E402
from ..functions.ipv4 import IPV4_STRICT  # noqa: E402

_ = UNKNOWN_NOTE


def rnd(x: str, d: int) -> str:
    return f"(round(({x}) * 1e{d}) / 1e{d})"


FEAT = f"""feat as (select source_ip,
  count(*){D} as event_count,
  avg(least(coalesce(failed_attempts, 0{D}), 1.0{D})) as failed_ratio,
  count(distinct port){D} as distinct_ports,
  count(distinct destination_ip){D} as distinct_destinations,
  count(distinct request_path){D} as distinct_paths,
  count(distinct username){D} as distinct_usernames,
  avg(coalesce(payload_size, 0{D})) as avg_payload_size,
  avg(case when hour(timestamp) < 6 or hour(timestamp) >= 22 then 1.0{D} else 0.0{D} end) as off_hours_ratio
from sec where source_ip is not null group by source_ip)"""
MOM = "mom as (select " + ", ".join(
    f"avg({f}) as mu_{f}, case when stddev_pop({f}) = 0 or stddev_pop({f}) is null then 1.0{D} "
    f"else stddev_pop({f}) end as sd_{f}" for f in FEATURE_NAMES) + " from feat)"
ZRAW = "zr as (select feat.*, " + ", ".join(
    f"(coalesce({f}, 0{D}) - mu_{f}) / sd_{f} as z_{f}" for f in FEATURE_NAMES) + " from feat, mom)"
ZCOL = ", ".join(f"{rnd('z_' + f, 6)} as z_{f}" for f in FEATURE_NAMES)
SCORE = ("zs as (select source_ip, (" + " + ".join(f"abs({rnd('z_' + f, 6)})" for f in FEATURE_NAMES)
         + f") / {float(len(FEATURE_NAMES))}{D} as raw from zr)",
         "zmm as (select min(raw) as lo, max(raw) as hi, count(*) as n from zs)",
         f"""score as (select source_ip, case when n < 8 or not (hi > lo) then 0.0{D}
  else {rnd('(raw - lo) / (hi - lo)', 4)} end as anomaly_score from zs, zmm)""")
TOPF = ("tf_long as (" + " union all ".join(
    f"select source_ip, {i} as idx, '{f}' as feature, {rnd(f, 2)} as value, {rnd(f'-abs(z_{f})', 6)} as k from zr"
    for i, f in enumerate(FEATURE_NAMES)) + ")",
        "tf as (select *, row_number() over (partition by source_ip order by k, idx) as rn from tf_long)",
        """tf_names as (select source_ip, string_agg(replace(feature, '_', ' '), ', ' order by rn) as names
  from tf where rn <= 3 group by source_ip)""")


def _lines_sql() -> list[str]:
    """Detections of every rule plus unknown anomalies, with their evidence line."""
    it = lambda x: f"cast(round_even({x}, 0) as bigint)::varchar"
    return [
        f"""det as (
  select 'brute_force' as detection_type, 0 as detector_order, source_ip, coalesce(username, '') as k,
         window_start, window_end, least(1.0{D}, n / 24.0{D}) as severity, n as event_count,
         'IP ' || source_ip || ': ' || n::varchar || ' failed authentication attempts against user ''' ||
         coalesce(username, 'unattributed') || ''' within 10 minutes' as line
  from bf
  union all
  select 'credential_spray', 1, source_ip, '', window_start, window_end, least(1.0{D}, users / 24.0{D}), attempts,
         'IP ' || source_ip || ': Contacted ' || users::varchar || ' distinct user accounts with ' ||
         attempts::varchar || ' failed attempts (' || round(attempts / users{D}, 2)::varchar ||
         ' attempts/user on average) within 10 minutes'
  from cs_hit
  union all
  select 'port_scan', 2, source_ip, '', window_start, window_end, least(1.0{D}, n_ports / 45.0{D}), rows,
         'IP ' || source_ip || ': Contacted ' || n_ports::varchar || ' distinct ports on ' ||
         (case when coalesce(ps_tg_list, '') = '' then 0 else len(string_split(ps_tg_list, ',')) end)::varchar || ' host(s) within 5 minutes' ||
         case when seq >= 0.6 then ' (sequential scan pattern detected)' else '' end
  from ps_st join ps_seq using (source_ip) left join ps_tg using (source_ip)
  union all
  select 'endpoint_probe', 3, source_ip, '', window_start, window_end,
         greatest(least(1.0{D}, paths / 30.0{D}), least(1.0{D}, hits / 15.0{D})), rows,
         'IP ' || source_ip || ': Requested ' || paths::varchar || ' distinct paths with a ' ||
         {it(f"round(err, 2) * 100.0{D}")} || '% error-response rate' ||
         case when hits > 0 then ', including ' || hits::varchar || ' hits on known-sensitive paths' else '' end
  from ep_hit
  union all
  select 'unknown_anomaly', 4, s.source_ip, '', sp.ws, sp.we, s.anomaly_score, sp.n,
         'IP ' || s.source_ip || ': Behaviour differs from the normal baseline for this dataset (anomaly score ' ||
         {it(f"s.anomaly_score * 100.0{D}")} || '%), notably in: ' || tn.names
  from score s
  join (select source_ip, min(timestamp) as ws, max(timestamp) as we, count(*) as n from sec
        where source_ip is not null group by source_ip) sp using (source_ip)
  join tf_names tn using (source_ip)
  where s.anomaly_score >= 0.7 and s.source_ip not in (
    select source_ip from bf union select source_ip from cs_hit union select source_ip from ps_st
    union select source_ip from ep_hit))"""]


def risk_ctes(mapping_confidence: float = 1.0) -> list[str]:
    mc = repr(0.4 * mapping_confidence)
    return [
        "cnt as (select source_ip, count(*) as event_count from sec where source_ip is not null group by source_ip)",
        "mx as (select max(event_count) as m from cnt)",
        "dsev as (select source_ip, max(severity) as sev from det group by source_ip)",
        "cand as (select source_ip from dsev union select source_ip from score where anomaly_score >= 0.4)",
        f"""prof as (select c.source_ip, coalesce(cnt.event_count, 0) as event_count,
   {rnd(f'coalesce(sev, 0{D})', 4)} as threat_severity,
   {rnd(f'coalesce(anomaly_score, 0{D})', 4)} as behavior_anomaly,
   {rnd(f'case when m > 0 then ln(1 + coalesce(cnt.event_count, 0)) / ln(1 + m) else 0{D} end', 4)} as frequency,
   {rnd(f'0.6{D} * least(1.0{D}, coalesce(cnt.event_count, 0) / 20.0{D}) + {mc}{D}', 4)} as confidence
 from cand c left join dsev using (source_ip) left join score using (source_ip) left join cnt using (source_ip), mx)""",
        f"""risk as (select *, 100.0{D} * (0.4{D} * threat_severity + 0.3{D} * behavior_anomaly
   + 0.15{D} * frequency + 0.15{D} * confidence) as raw from prof)""",
        f"""scored as (select source_ip, event_count, threat_severity, behavior_anomaly, frequency, confidence,
   {rnd('raw', 1)} as risk_score,
   case when raw >= 80 then 'Critical' when raw >= 60 then 'High' when raw >= 40 then 'Medium' else 'Low' end
     as classification from risk)"""]


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _case_map(expr: str, mapping: dict) -> str:
    body = " ".join(f"when {lit(k)} then {lit(v)}" for k, v in mapping.items())
    return f"case {expr} {body} end"


def explain_ctes() -> list[str]:
    recs = {k: " | ".join(v) for k, v in RECOMMENDATIONS.items()}
    return [
        "dt as (select distinct source_ip, detection_type from det)",
        f"""lab as (select source_ip, count(*) as ntypes,
   string_agg({_case_map('detection_type', THREAT_LABELS)}, ', ' order by detection_type) as labels from dt
   group by source_ip)""",
        """dom as (select source_ip, detection_type as dominant from (select *, row_number() over (
   partition by source_ip order by severity desc, detector_order, k) as rn from det) where rn = 1)""",
        """dl as (select source_ip, bool_or(detection_type = 'unknown_anomaly') as has_unknown from det group by source_ip)""",
        f"""expl as (select s.*,
   case when dom.dominant is null then '{NO_RULE_THREAT}'
        when ntypes > 1 then '{MULTIPLE_PREFIX}' || labels
        else {_case_map('dom.dominant', THREAT_LABELS)} end as threat,
   case when dom.dominant is null then {lit(recs["unknown_anomaly"])} else {_case_map('dom.dominant', recs)} end
     as recommendation,
   {rnd(f'confidence * 100.0{D}', 1)} as confidence_pct,
   case when threat_severity > 0 or behavior_anomaly >= 0.4 or frequency >= 0.6 then
     '{REASON_PREFIX}' || concat_ws(' and ',
        case when threat_severity > 0 then '{REASON_RULE}' end,
        case when behavior_anomaly >= 0.4 then '{REASON_BEHAVIOUR}' end,
        case when frequency >= 0.6 then '{REASON_VOLUME}' end) || '.'
   else '{REASON_LOW}' end as reason
 from scored s left join lab using (source_ip) left join dom using (source_ip) left join dl using (source_ip)
 left join tf_names tn using (source_ip))"""]


IPLONG = (f"case when regexp_full_match(ip, '{IPV4_STRICT}') then "
          "split_part(ip, '.', 1)::bigint * 16777216 + split_part(ip, '.', 2)::bigint * 65536 + "
          "split_part(ip, '.', 3)::bigint * 256 + split_part(ip, '.', 4)::bigint end")


def geo_ctes(src: str) -> list[str]:
    """``geo_out``: every row of ``src`` (column ip) with its longest-prefix location."""
    return [
        f"geo_ip as (select *, {IPLONG} as ip_long from {src})",
        f"""geo_m as (select gi.ip, g.country, g.country_code, g.city, g.lat::double as lat, g.lon::double as lon,
   row_number() over (partition by gi.ip order by g.prefix_len desc) as rn
   from (select distinct ip, ip_long from geo_ip) gi join {geo_values_sql()}
   on (gi.ip_long >> (32 - g.prefix_len)) = (g.network >> (32 - g.prefix_len)))""",
        """geo_out as (select geo_ip.*, coalesce(m.country, 'Unknown') as country,
   coalesce(m.country_code, 'XX') as country_code, coalesce(m.city, 'Unknown') as city, m.lat, m.lon
   from geo_ip left join (select * from geo_m where rn = 1) m on geo_ip.ip is not distinct from m.ip)"""]


def analysis_ctes(mapping_confidence: float = 1.0) -> list[str]:
    return [BF_SRC, densest("bf", "bf_src", "source_ip, username", 10, 8), *CS_BODY, *PS_BODY, *EP_BODY,
            FEAT, MOM, ZRAW, *SCORE, *TOPF, *_lines_sql(), *risk_ctes(mapping_confidence), *explain_ctes()]


def analysis_sql(select: str, *extra: str) -> str:
    return ctes(*analysis_ctes(), *extra) + select


IP_FEATURES = ctes(FEAT) + "select * from feat"
IP_ZSCORES = ctes(FEAT, MOM, ZRAW) + f"select source_ip, {ZCOL} from zr"
TOP_FEATURES = ctes(FEAT, MOM, ZRAW, *TOPF) + """
select source_ip,
  max(case when rn = 1 then feature end) as feature_1, max(case when rn = 1 then value end) as value_1,
  max(case when rn = 2 then feature end) as feature_2, max(case when rn = 2 then value end) as value_2,
  max(case when rn = 3 then feature end) as feature_3, max(case when rn = 3 then value end) as value_3
from tf where rn <= 3 group by source_ip"""
ZSCORE_ANOMALY = ctes(FEAT, MOM, ZRAW, *SCORE) + "select source_ip, anomaly_score from score"
IP_EVENT_COUNTS = ctes() + """select source_ip, count(*) as event_count from sec where source_ip is not null
group by source_ip"""
RISK_SCORES = analysis_sql("""select source_ip, event_count, threat_severity, behavior_anomaly, frequency,
  confidence, risk_score, classification from scored""")
CANDIDATE_IPS = analysis_sql("select source_ip from cand")
RISK_BANDS = analysis_sql("select classification, count(*) as alerts from scored group by classification")
EXPLAIN_THREAT = analysis_sql("select source_ip, threat from expl")
EXPLAIN_RECOMMEND = analysis_sql("select source_ip, recommendation from expl")
EXPLAIN_EVIDENCE = analysis_sql(f"""select source_ip, detector_order, k as target, line from det semi join scored using (source_ip)
union all select source_ip, 9, '', {lit(BASELINE_LINE)} || tn.names from scored s left join dl using (source_ip)
 join tf_names tn using (source_ip)
 where behavior_anomaly >= 0.4 and not coalesce(dl.has_unknown, false) and tn.names is not null""")
EXPLAIN_REASON = analysis_sql("select source_ip, reason, confidence_pct from expl")
GEO_JOIN = ctes("ips as (select distinct source_ip as ip from sec where source_ip is not null)",
                *geo_ctes("ips")) + """
select ip as source_ip, country, country_code, city, lat, lon from geo_out"""
LOCATION_FILL = ctes("ev as (select event_id, source_ip as ip from sec)", *geo_ctes("ev")) + """
select event_id, ip as source_ip, case when ip is not null then country end as source_location from geo_out"""


# ------------------------------------------------------------------ serving views
def bucket_sql(ts: str, minutes: int = 30) -> str:
    b = minutes * 60_000_000
    return f"make_timestamp(epoch_us({ts}) - (((epoch_us({ts}) % {b}) + {b}) % {b}))"


_TYPES = ["brute_force", "credential_spray", "port_scan", "endpoint_probe", "unknown_anomaly"]
_ALERT_COLS = ("source_ip, risk_score, classification, threat_severity, behavior_anomaly, frequency, confidence, "
               "event_count, threat")
_VOL = f"vol as (select {bucket_sql('timestamp')} as bucket, count(*) as total_events from sec " \
       "where timestamp is not null group by 1)"
_DETB = "detb as (select " + bucket_sql("window_start") + " as bucket, " + ", ".join(
    f"count(*) filter (where detection_type = '{t}') as {t}" for t in _TYPES) + \
    " from det where window_start is not null group by 1)"
_TL = "tl as (select vol.bucket, total_events, " + ", ".join(f"coalesce({t}, 0) as {t}" for t in _TYPES) + \
      " from vol left join detb using (bucket))"

OVERVIEW_KPIS = analysis_sql("""select (select count(*) from sec) as total_events,
  (select count(distinct source_ip) from sec) as unique_source_ips,
  (select count(*) from det) as threats_detected,
  (select count(*) from expl where classification = 'Critical') as critical_alerts""")
RISK_DISTRIBUTION = analysis_sql("""select b.classification, b.band_order, coalesce(c.n, 0) as alerts
from (values ('Critical', 0), ('High', 1), ('Medium', 2), ('Low', 3)) as b(classification, band_order)
left join (select classification, count(*) as n from expl group by 1) c using (classification)""")
ATTACK_CATEGORIES = analysis_sql("select detection_type, count(*) as detections from det group by 1")
TIMELINE_VOLUME = ctes(_VOL) + "select bucket, total_events from vol"
TIMELINE = analysis_sql("select * from tl", _VOL, _DETB, _TL)
TIMELINE_PIVOT = analysis_sql("select * from tl where " + " or ".join(f"{t} > 0" for t in _TYPES),
                              _VOL, _DETB, _TL)
ALERTS_TOPK = analysis_sql(f"select {_ALERT_COLS} from expl order by risk_score desc, source_ip limit 100")
TOP_OFFENDERS = analysis_sql(f"select {_ALERT_COLS} from expl order by risk_score desc, source_ip limit 10")
BEHAVIOUR_ANOMALIES = analysis_sql(f"""select {_ALERT_COLS} from expl where behavior_anomaly >= 0.5
order by risk_score desc, source_ip limit 10""")
IP_TOTAL = analysis_sql("""select i.source_ip, coalesce(e.n, 0) as total_events, coalesce(d.n, 0) as detections
from (select source_ip from expl union select source_ip from det) i
left join (select source_ip, count(*) as n from sec group by 1) e using (source_ip)
left join (select source_ip, count(*) as n from det group by 1) d using (source_ip)""")
IP_EVENTS = analysis_sql("""select source_ip, event_rank, event_id, timestamp, event_type, username, port,
  request_path, status_code from (
  select s.*, row_number() over (partition by s.source_ip order by s.timestamp asc nulls last, s.event_id)
    as event_rank
  from sec s where s.source_ip in (select source_ip from expl))
where event_rank <= 200""")
IP_INVESTIGATION = analysis_sql("""select source_ip, event_rank, event_id, timestamp, total_events,
  (select count(*) from det d where d.source_ip = x.source_ip) as detections from (
  select s.*, row_number() over (order by s.timestamp asc nulls last, s.event_id) as event_rank, count(*) over () as total_events
  from sec s where s.source_ip = (select source_ip from expl order by risk_score desc, source_ip limit 1)) x
where event_rank <= 200""")
ATTACK_PROGRESSION = analysis_sql("""select source_ip,
  row_number() over (partition by source_ip order by window_start asc nulls first, detector_order, k) as step,
  detection_type, window_start, window_end, severity, event_count from det""")
GEO_DISTRIBUTION = analysis_sql("""select country, country_code, count(*) as alert_count,
  round(avg(risk_score) * 1e1) / 1e1 as avg_risk_score,
  first(lat order by risk_score desc, source_ip) filter (where lat is not null) as lat,
  first(lon order by risk_score desc, source_ip) filter (where lat is not null) as lon
from (select g.ip as source_ip, g.country, g.country_code, g.lat, g.lon, e.risk_score
      from geo_out g join expl e on g.ip = e.source_ip) x
group by country, country_code""", "aips as (select source_ip as ip from expl)", *geo_ctes("aips"))
PEAK_RISK = analysis_sql("""select max(risk_score) as peak_risk_score,
  first(source_ip order by risk_score desc, source_ip) as peak_source_ip,
  count(*) filter (where classification in ('Critical', 'High')) as elevated_alerts,
  (select count(distinct detection_type) from det) as types_fired
from expl""")


# ------------------------------------------------------------------ ingestion / text
from ..functions.stopwords import ENGLISH  # noqa: E402

_STOP = "[" + ", ".join(lit(w) for w in ENGLISH) + "]"


def tfidf_sql(src: str, doc: str, text: str) -> list[str]:
    return [
        f"""tk as (select {doc} as doc, list_filter(regexp_extract_all(lower({text}), '({TOKEN})', 1),
   lambda t: not list_contains({_STOP}, t)) as tok from {src})""",
        """gr as (select doc, unnest(tok) as term from tk
   union all
   select doc, tok[i] || ' ' || tok[i + 1] from (select doc, tok, unnest(range(1, len(tok))) as i from tk))""",
        "tf as (select doc, term, count(*)::double as tf from gr group by all)",
        f"nd as (select count(*) as n from {src})",
        "idf as (select term, ln((n + 1) / (count(*) + 1)) + 1 as idf from tf, nd group by term, n)",
        "wt as (select doc, term, tf * idf as w from tf join idf using (term))",
        "nm as (select doc, sqrt(sum(w * w)) as norm from wt group by doc)",
        "vec as (select doc, term, w / norm as w from wt join nm using (doc))"]


TFIDF_DOCUMENTS = ctes(*tfidf_sql("documents", "doc_id", "text")) + f"""
select doc as doc_id, count(*) as n_terms,
  first(term order by {rnd('w', 9)} desc, term) as top_term, max({rnd('w', 6)}) as top_weight
from vec group by doc"""

EMBEDDING_MATCH = ctes(
    """cells as (select vec_id, label, i, embedding[i]::double as x from
   (select vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) as i from embeddings))""",
    "cent as (select label as concept, i, avg(x) as c from cells group by label, i)",
    "cn as (select concept, sqrt(sum(c * c)) as cn from cent group by concept)",
    "vn as (select vec_id, sqrt(sum(x * x)) as vn from cells group by vec_id)",
    "dots as (select vec_id, concept, sum(x * c) as dot from cells join cent using (i) group by vec_id, concept)",
    f"cs as (select vec_id, concept, {rnd('dot / (vn * cn)', 9)} as cos from dots join vn using (vec_id) join cn using (concept))",
    "sm as (select *, exp((cos - max(cos) over (partition by vec_id)) / 0.1) as e from cs)",
    "sp as (select *, e / sum(e) over (partition by vec_id) as p from sm)") + f"""
select vec_id, first(concept order by cos desc, concept) as best_label, max({rnd('cos', 6)}) as cosine,
  max({rnd('p', 4)}) as confidence from sp group by vec_id"""


def _num(x: str) -> str:
    return (f"case when regexp_full_match({x}, '{NUMBER_TEXT.lstrip('^').rstrip('$')}') "
            f"then try_cast(trim({x}) as double) end")


NORMALIZE_NUMERIC = ctes() + f"""
select event_id, {_num('cast(port as varchar)')} as port_n, {_num('source_ip')} as ip_n,
  {_num("regexp_replace(props, '[^0-9]', '', 'g')")} as props_n, {_num('props')} as props_raw_n
from sec"""

FAILURE_INDICATOR = ctes() + f"""
select event_id,
  case when regexp_matches(event_type, '(?i)({FAILURE_PATTERN})') then 1 else 0 end as event_type_failed,
  case when regexp_matches(props, '(?i)({FAILURE_PATTERN})') then 1 else 0 end as props_failed
from sec"""

NORMALIZE_TIMESTAMP = ctes() + """
select event_id, try_cast(cast(timestamp as varchar) as timestamp) as ts_iso,
  try_strptime(strftime(timestamp, '%m/%d/%Y %I:%M:%S %p'), '%m/%d/%Y %I:%M:%S %p') as ts_us
from sec"""


# ------------------------------------------------------------------ ontology / profiling / normalisation
from ..operators.ontology import CONCEPTS, DISPLAY_NAMES  # noqa: E402

_SEC_FIELDS = ["source_ip", "destination_ip", "timestamp", "username", "event_type", "failed_attempts", "port",
               "protocol", "request_path", "status_code", "payload_size", "device_id"]
ONTOLOGY = ctes("cov as (" + " union all ".join(
    f"select '{k}' as key, count({k}) as n from sec" for k in _SEC_FIELDS) + ")") + \
    "select t.key, concept_index, expected_dtype, display_name, description, coalesce(cov.n, 0) as events_with_value from (values " + \
    ", ".join(f"({lit(k)}, {i}, {lit(d)}, {lit(DISPLAY_NAMES[k])}, {lit(t)})" for i, (k, d, _, t) in enumerate(CONCEPTS)) + \
    ") as t(key, concept_index, expected_dtype, display_name, description) left join cov using (key)"

SEC_COLUMNS = ["source_ip", "destination_ip", "timestamp", "username", "event_type", "failed_attempts", "port",
               "protocol", "request_path", "status_code", "payload_size", "device_id", "props"]


def _profile_sec_sql() -> str:  # whole table
    long = " union all ".join(
        f"select '{c}' as column_name, {i} as col_index, event_id as row_id, cast({c} as varchar) as value from head"
        for i, c in enumerate(SEC_COLUMNS))
    num = f"case when regexp_full_match(value, '{PROFILE_NUMBER.lstrip('^').rstrip('$')}') " \
          "then try_cast(trim(value) as double) end"
    return ctes("head as (select * from sec)", f"lv as ({long})",
                """nn as (select *, row_number() over (partition by column_name order by row_id) as rn
   from lv where value is not null)""",
                f"""st as (select column_name, count(*) as n, count(distinct value) as nd,
   avg(case when rn <= 200 then (regexp_full_match(value, '{IPV4_SHAPE_SQL}'))::int::double end) as ip_share,
   bool_and(({num}) is not null) as all_num,
   avg(regexp_full_match(value, '{INTEGER_TEXT.lstrip('^').rstrip('$')}')::int::double) as int_share,
   bool_and(case when rn <= 50 then regexp_matches(value, '{DATE_SHAPE}')
                                   and try_cast(value as timestamp) is not null end) as all_ts
   from nn group by column_name)""",
                "cols as (select distinct column_name, col_index from lv)") + """
select c.column_name, c.col_index, coalesce(n, 0) as n_nonnull, coalesce(nd, 0) as n_distinct,
  case when coalesce(n, 0) = 0 then 'unknown'
       when ip_share > 0.8 then 'ip'
       when all_num then case when int_share > 0.8 then 'integer' else 'float' end
       when all_ts then 'datetime'
       when nd / n < 0.05 and nd <= 20 then 'categorical'
       else 'string' end as inferred_dtype
from cols c left join st using (column_name)"""


IPV4_SHAPE_SQL = r"\d{1,3}(\.\d{1,3}){3}"
PROFILE_SEC = _profile_sec_sql()

_TXT = ", ".join(f"cast({c} as varchar) as {c}" for c in ["event_id"] + SEC_COLUMNS)
NORMALIZE_PROJECT = ctes(f"raw as (select {_TXT} from sec)") + f"""
select source_ip, destination_ip, try_cast(timestamp as timestamp) as timestamp, username, event_type,
  {_num('failed_attempts')} as failed_attempts, {_num('port')} as port, protocol, request_path,
  {_num('status_code')} as status_code, {_num('payload_size')} as payload_size, device_id,
  cast(null as varchar) as source_location,
  to_json(struct_pack(event_id := event_id, props := props)) as extra_fields
from raw"""

FAILURE_FROM_EVENT_TYPE = ctes() + f"""
select event_id, (case when regexp_matches(event_type, '(?i)({FAILURE_PATTERN})') then 1 else 0 end)::double
  as failed_attempts from sec"""


# ------------------------------------------------------------------ descriptors and match scores of `sec`
from ..operators.ontology import DTYPE_COMPATIBILITY  # noqa: E402


def _sec_profile_ctes(limit: str = "", columns: dict[str, str] | None = None) -> list[str]:
    long = " union all ".join(
        f"select '{n}' as column_name, {i} as col_index, event_id as row_id, cast({c} as varchar) as value from head"
        for i, (n, c) in enumerate((columns or {c: c for c in SEC_COLUMNS}).items()))
    num = f"case when regexp_full_match(value, '{PROFILE_NUMBER.lstrip('^').rstrip('$')}') " \
          "then try_cast(trim(value) as double) end"
    return [
        f"head as (select * from sec order by event_id{limit})", f"lv as ({long})",
        """nn as (select *, row_number() over (partition by column_name order by row_id) as rn
   from lv where value is not null)""",
        f"""st as (select column_name, count(*) as n, count(distinct value) as nd,
   avg(case when rn <= 200 then (regexp_full_match(value, '{IPV4_SHAPE_SQL}'))::int::double end) as ip_share,
   bool_and(({num}) is not null) as all_num,
   avg(regexp_full_match(value, '{INTEGER_TEXT.lstrip('^').rstrip('$')}')::int::double) as int_share,
   bool_and(case when rn <= 50 then regexp_matches(value, '{DATE_SHAPE}')
                                   and try_cast(value as timestamp) is not null end) as all_ts,
   min({num}) as vmin, max({num}) as vmax, avg({num}) as vmean
   from nn group by column_name)""",
        "cols as (select distinct column_name, col_index from lv)",
        """fr as (select column_name, value, min(row_id) as first_row, count(*) as freq from nn group by all)""",
        """rk as (select *, row_number() over (partition by column_name order by first_row) as r_first,
   row_number() over (partition by column_name order by freq desc, first_row) as r_freq from fr)""",
        """samp as (select column_name,
   string_agg(value, ', ' order by r_first) filter (where r_first <= 5) as samples,
   string_agg(value, ', ' order by r_freq) filter (where r_freq <= 5) as tops from rk group by column_name)""",
        """dt as (select c.column_name, c.col_index, st.*, samp.samples, samp.tops,
   case when coalesce(n, 0) = 0 then 'unknown'
        when ip_share > 0.8 then 'ip'
        when all_num then case when int_share > 0.8 then 'integer' else 'float' end
        when all_ts then 'datetime'
        when nd / n < 0.05 and nd <= 20 then 'categorical'
        else 'string' end as inferred_dtype
   from cols c left join st using (column_name) left join samp using (column_name))""",
        """descr as (select column_name, col_index, inferred_dtype,
   'Column named ''' || column_name || ''' (read as ''' || trim(regexp_replace(column_name, '[_\\-.]+', ' ', 'g'))
   || '''). Inferred type: ' || inferred_dtype || '. ' ||
   case inferred_dtype when 'unknown' then 'column is entirely empty'
     when 'integer' then 'numeric values ranging from ' || printf('%g', vmin) || ' to ' || printf('%g', vmax)
                         || ', mean ' || printf('%.2f', vmean)
     when 'float' then 'numeric values ranging from ' || printf('%g', vmin) || ' to ' || printf('%g', vmax)
                         || ', mean ' || printf('%.2f', vmean)
     when 'categorical' then 'categorical values, most common: ' || tops
     when 'ip' then 'values formatted as dotted-decimal IPv4 addresses'
     when 'datetime' then 'values formatted as timestamps or dates'
     else 'text values, examples: ' || samples end || '.' as descriptor
   from dt)"""]


PROFILE_HEAD = ctes(*_sec_profile_ctes(" limit 1000")) + "select column_name, inferred_dtype, descriptor from descr"
PROFILE_SEC_DESCRIPTOR = ctes(*_sec_profile_ctes()) + "select column_name, inferred_dtype, descriptor from descr"

_ONTO_VALUES = "(values " + ", ".join(
    f"({lit(k)}, {i}, {lit(d)}, [{', '.join(lit(h) for h in hints)}], {lit(t)})"
    for i, (k, d, hints, t) in enumerate(CONCEPTS)) + \
    ") as onto(concept, concept_index, expected_dtype, hints, description)"
_COMPAT = " ".join(f"when {lit(k)} then [{', '.join(lit(v) for v in vs)}]" for k, vs in DTYPE_COMPATIBILITY.items())


_ONTO = f"onto as (select * from {_ONTO_VALUES})"


def _confidence_ctes(temperature: float) -> list[str]:
    """From descr (column_name, col_index, inferred_dtype) and sim: the softmax over the concepts of each column."""
    return [f"""grid as (select d.column_name, d.col_index, d.inferred_dtype, o.concept, o.concept_index,
   coalesce(s.sim, 0.0) as sim,
   coalesce(s.sim, 0.0)
   + case when len(list_filter(o.hints, lambda h: contains(lower(d.column_name), h))) > 0 then 0.08 else 0.0 end
   + case when (case d.inferred_dtype {_COMPAT} end) is null then 0.0
          when list_contains(case d.inferred_dtype {_COMPAT} end, o.expected_dtype) then 0.05 else -0.10 end
     as raw
   from descr d cross join onto o left join sim s on s.column_name = d.column_name and s.concept = o.concept)""",
            f"""soft as (select *, exp((raw - max(raw) over (partition by column_name)) / {temperature}) as e from grid)""",
            "conf as (select *, e / sum(e) over (partition by column_name) as confidence from soft)"]


def _match_sec_ctes(columns: dict[str, str] | None = None) -> list[str]:
    return [*_sec_profile_ctes("", columns), _ONTO,
            """docs as (select 'concept:' || concept as doc, description as text from onto
   union all select column_name, descriptor from descr)""",
            *tfidf_sql("docs", "doc", "text"),
            """sim as (select d.doc as column_name, substr(c.doc, 9) as concept, sum(d.w * c.w) as sim
   from vec d join vec c on d.term = c.term
   where d.doc not like 'concept:%' and c.doc like 'concept:%' group by all)""",
            *_confidence_ctes(0.05)]


MATCH_SCORES_SEC = ctes(*_match_sec_ctes()) + f"""
select column_name, concept, {rnd('sim', 9)} as sim, {rnd('confidence', 6)} as confidence from conf"""


def assign_sql(dataset: str, scores: list[str], pins: dict[str, str | None] | None = None) -> str:
    """M-7 .. M-9: the surest pair whose column and field are both free, round by round; pins leave first."""
    rows = " union all ".join(f"select {lit(c)} as column_name, {lit(f) if f else 'null::varchar'} as pin" for c, f in (pins or {}).items())
    body = ctes(*scores, f"pins as ({rows or 'select null::varchar as column_name, null::varchar as pin where false'})",
                """open_pairs as (select column_name, col_index, concept, concept_index, confidence from conf
   where confidence >= 0.35 and column_name not in (select column_name from pins)
     and concept not in (select pin from pins where pin is not null))""",
                """picked as (select 0 as round, []::varchar[] as cols, []::varchar[] as fields, null::varchar as column_name,
     null::varchar as found, null::double as sure
   union all
   select p.round + 1, list_append(p.cols, b.column_name), list_append(p.fields, b.concept), b.column_name, b.concept, b.confidence
   from picked p cross join lateral (select * from open_pairs o
     where not list_contains(p.cols, o.column_name) and not list_contains(p.fields, o.concept)
     order by o.confidence desc, o.col_index, o.concept_index limit 1) b)""",
                "columns_ as (select distinct column_name, col_index, inferred_dtype from conf)",
                """fielded as (select c.*, n.column_name is not null as manual, coalesce(n.pin, p.found) as field, n.pin, p.sure
   from columns_ c left join (select * from picked where round > 0) p using (column_name) left join pins n using (column_name))""",
                """lone as (select count(*) filter (where inferred_dtype = 'ip') = 1
     and count(*) filter (where field = 'source_ip') = 0 as alone from fielded)""",
                """turned as (select *, alone and inferred_dtype = 'ip' and not manual
     and (field is null or field = 'destination_ip') as turns from fielded, lone)""")
    return "with recursive" + body[len("with"):] + f"""
select {lit(dataset)} as dataset_id, column_name, col_index, case when turns then 'source_ip' else field end as mapped_field,
  round(case when pin is not null then 1.0 else coalesce(sure, case when turns then 0.5 else 0.0 end) end::double, 4) as confidence,
  case when manual then 'manual' else 'inferred' end as source
from turned"""


MATCH_ASSIGN_SEC = assign_sql("sec", _match_sec_ctes())
MATCH_OVERRIDE = assign_sql("sec", _match_sec_ctes(), {"port": None, "props": "source_location"})
MATCH_SINGLE_IP = assign_sql("lone", _match_sec_ctes({"rhost": "source_ip", "user": "username", "result": "event_type"}))

_KEYS_VALUES = "(values " + ", ".join(f"({i}, {lit(k)})" for i, (k, *_) in enumerate(CONCEPTS)) + ") as k(vec_id, concept)"
EMBEDDING_COSINE = ctes(
    """cells as (select vec_id, i, embedding[i]::double as x
   from (select vec_id, embedding, unnest(range(1, len(embedding) + 1)) as i from embeddings))""",
    "norms as (select vec_id, sqrt(sum(x * x)) as n from cells group by vec_id)",
    f"concept_cells as (select concept, i, x, n from cells join norms using (vec_id) join {_KEYS_VALUES} using (vec_id))",
    """sim as (select 'c' || c.vec_id as column_name, concept, sum(c.x * k.x) / (any_value(m.n) * any_value(k.n)) as sim
   from cells c join norms m using (vec_id) join concept_cells k using (i) group by c.vec_id, concept)""",
    "descr as (select 'c' || vec_id as column_name, vec_id as col_index, 'string' as inferred_dtype from embeddings)",
    _ONTO, *_confidence_ctes(0.1)) + f"""
select column_name, concept, {rnd('sim', 6)} as sim, {rnd('confidence', 6)} as confidence from conf"""

SPRAY_TARGETS = ctes(*CS_BODY) + """
select source_ip, username, min(event_id) as first_row from cs_in join (select distinct source_ip from cs_hit) using (source_ip)
group by source_ip, username"""


# ------------------------------------------------------------------ readers
READ_CSV = ctes() + """
select event_id, 'he said "' || event_type || '", ok' as note, username from sec where event_id % 50 <> 0"""
READ_NDJSON = ctes() + "select event_id, source_ip, port, username from sec"
READ_CSV_QUOTED = ctes() + """
select event_id, 'é "' || event_type || '",' || chr(10) || 'ok' as note, username from sec"""
READ_NDJSON_ESCAPES = ctes() + """
select event_id, 'say "[" to {' || event_type || chr(92) || '"}]' as msg, port from sec"""
READ_WRAPPED_JSON = ctes() + "select event_id, source_ip, port as net_port, username as net_user from sec"


# ------------------------------------------------------------------ profiles of every table, mappings, unmapped fields
PROFILE_LONG = ctes("head as (select * from sec)") + " union all ".join(
    f"select '{c}' as column_name, {i} as col_index, event_id as row_id, cast({c} as varchar) as value from head"
    for i, c in enumerate(SEC_COLUMNS))

PROFILE_SHAPE = ctes(*_sec_profile_ctes()) + """
select d.column_name, d.inferred_dtype, l.samples,
  substr(d.descriptor, strpos(d.descriptor, 'Inferred type: ') + length('Inferred type: ' || d.inferred_dtype || '. ')) as shape
from descr d left join (select column_name, string_agg(value, ' | ' order by r_first) as samples from rk where r_first <= 5 group by 1) l
  using (column_name)"""

_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
           "benchmark", "labels", "conversations"]
_DTYPE_NUM = f"case when regexp_full_match(value, '{PROFILE_NUMBER.lstrip('^').rstrip('$')}') then try_cast(trim(value) as double) end"


def _unpivoted(name: str, rows: str) -> str:
    return (f"select '{name}' as dataset_id, column_name, row_id, value from ({rows}) "
            "unpivot include nulls (value for column_name in (columns(* exclude (row_id))))")


PROFILE_DTYPE = ctes("lv as (" + " union all ".join(
    [_unpivoted(t, f"select row_number() over () as row_id, columns(*)::varchar from {t}") for t in _TABLES]
    + [_unpivoted("sec", "select event_id as row_id, " + ", ".join(f"cast({c} as varchar) as {c}" for c in SEC_COLUMNS) + " from sec")]) + ")",
    "nn as (select *, row_number() over (partition by dataset_id, column_name order by row_id) as rn from lv where value is not null)",
    f"""st as (select dataset_id, column_name, count(*) as n, count(distinct value) as nd,
   avg(case when rn <= 200 then (regexp_full_match(value, '{IPV4_SHAPE_SQL}'))::int::double end) as ip_share,
   bool_and(({_DTYPE_NUM}) is not null) as all_num,
   avg(regexp_full_match(value, '{INTEGER_TEXT.lstrip('^').rstrip('$')}')::int::double) as int_share,
   bool_and(case when rn <= 50 then regexp_matches(value, '{DATE_SHAPE}') and try_cast(value as timestamp) is not null end) as all_ts
   from nn group by all)""") + """
select c.dataset_id, c.column_name,
  case when coalesce(n, 0) = 0 then 'unknown'
       when ip_share > 0.8 then 'ip'
       when all_num then case when int_share > 0.8 then 'integer' else 'float' end
       when all_ts then 'datetime'
       when nd / n < 0.05 and nd <= 20 then 'categorical'
       else 'string' end as inferred_dtype
from (select distinct dataset_id, column_name from lv) c left join st using (dataset_id, column_name)"""

MAPPING_SUMMARY_SEC = f"""with m as ({MATCH_ASSIGN_SEC}), p as ({ctes(*_sec_profile_ctes())}
  select d.column_name, d.inferred_dtype, l.samples from descr d
  left join (select column_name, string_agg(value, ' | ' order by r_first) as samples from rk where r_first <= 3 group by 1) l using (column_name))
select 'sec' as dataset_id, column_name, mapped_field, confidence, source, inferred_dtype, coalesce(samples, '') as sample_values
from m join p using (column_name)"""
MAPPING_CONFIDENCE_SEC = f"select dataset_id, {rnd('avg(confidence)', 6)} as avg_confidence from ({MATCH_ASSIGN_SEC}) group by all"
MAPPING_REVIEW_SEC = f"""select column_name, mapped_field, confidence from ({MATCH_ASSIGN_SEC})
where source <> 'manual' and confidence > 0 and confidence < 0.6"""
OVERRIDE_DIFF = f"""select column_name, a.mapped_field as "old", b.mapped_field as "new"
from ({MATCH_ASSIGN_SEC}) a full join ({MATCH_OVERRIDE}) b using (column_name) where a.mapped_field is distinct from b.mapped_field"""

EXTRA_FIELDS = ctes() + """
select source_ip, to_json(struct_pack("event_id" := event_id, "is ssh" := port = 22, "share" := status_code / 8, "user.name" := username,
  "net" := struct_pack("port" := port, "hosts" := [device_id, destination_ip]))) as extra_fields from sec"""
