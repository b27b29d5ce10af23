"""The ``sec`` security log: a canonical event table derived from ``events``.

Every analytic query of the package reads this view. Personas are keyed by
``user_id % 10`` (brute force, spraying, port scan, endpoint probe, off-hours
exfiltration, background). Time arithmetic uses TIMESTAMP_NTZ and
``timestampdiff``/``timestampadd`` so the result is independent of the session
time zone. ``event_id`` doubles as the row order (``row_id``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .tables import read_table

# Fixed values of the fixture: first octets (30 geo /8 ranges + 10 for
# "unknown"), the probe persona's sensitive paths and the normal paths.
FIRST_OCTETS = "3,45,64,104,23,142,80,81,90,95,178,91,36,114,1,121,126,133,103,117,202,203,196,41,177,181,190,217,109,88,10"
PROBE_PATHS = ("'/admin','/.env','/wp-login.php','/phpmyadmin','/.git/config','/etc/passwd',"
               "'/config.php.bak','/api/internal/debug','/../../../../etc/shadow','/server-status','/actuator/env'")
NORMAL_PATHS = ("'/','/dashboard','/api/v1/profile','/login','/static/app.js','/api/v1/orders',"
                "'/favicon.ico','/api/v1/health'")

_FAILED = "(event_type = 'error' OR (user_id % 10 IN (0, 1) AND event_type <> 'view'))"

SEC_SPARK_SQL = f"""
SELECT event_id,
  CASE WHEN event_id % 97 = 0 THEN NULL ELSE concat(
      cast(element_at(array({FIRST_OCTETS}), cast(user_id % 31 AS INT) + 1) AS STRING), '.',
      cast(user_id % 256 AS STRING), '.', cast((user_id * 7) % 256 AS STRING), '.',
      cast((user_id * 13) % 254 + 1 AS STRING)) END AS source_ip,
  CASE WHEN user_id % 10 = 2 THEN '10.50.0.3'
       ELSE concat('10.50.', cast(event_id % 6 AS STRING), '.', cast(event_id % 254 + 1 AS STRING)) END AS destination_ip,
  CASE WHEN event_id % 101 = 0 THEN NULL
       WHEN user_id % 10 < 4 THEN timestampadd(MICROSECOND,
            user_id * 3600000000 + (timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) div 10000),
            TIMESTAMP_NTZ'2024-01-01 00:00:00')
       WHEN user_id % 50 = 4 THEN timestampadd(MICROSECOND,
            (timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) div 86400000000) * 86400000000
              + 82800000000 + (event_id % 3600) * 1000000,
            TIMESTAMP_NTZ'2024-01-01 00:00:00')
       ELSE ts END AS timestamp,
  CASE WHEN user_id % 10 = 0 THEN concat('victim', cast(user_id AS STRING))
       WHEN user_id % 10 = 1 THEN concat('user', cast(1000 + event_id % 60 AS STRING))
       WHEN user_id % 10 IN (2, 3) THEN NULL
       ELSE concat('u', cast(user_id AS STRING)) END AS username,
  CASE WHEN user_id % 10 = 2 THEN 'connection_attempt' WHEN user_id % 10 = 3 THEN 'http_request'
       WHEN {_FAILED} THEN 'login_failed' ELSE 'login_success' END AS event_type,
  cast(CASE WHEN user_id % 10 IN (2, 3) THEN 0 WHEN {_FAILED} THEN 1 ELSE 0 END AS DOUBLE) AS failed_attempts,
  cast(CASE WHEN user_id % 10 = 2 THEN 1 + event_id % 200
            ELSE element_at(array(22, 80, 443, 3389), cast(event_id % 4 AS INT) + 1) END AS DOUBLE) AS port,
  'tcp' AS protocol,
  CASE WHEN user_id % 10 = 2 THEN NULL
       WHEN user_id % 10 = 3 THEN element_at(array({PROBE_PATHS}), cast(event_id % 11 AS INT) + 1)
       ELSE element_at(array({NORMAL_PATHS}), cast(event_id % 8 AS INT) + 1) END AS request_path,
  cast(CASE WHEN user_id % 10 = 2 THEN NULL WHEN user_id % 10 = 3 THEN 404
            WHEN {_FAILED} THEN 401 ELSE 200 END AS DOUBLE) AS status_code,
  cast(CASE WHEN user_id % 50 = 4 THEN 50000 + event_id % 150000 ELSE 200 + event_id % 3800 END AS DOUBLE) AS payload_size,
  concat('host-', cast(1000 + event_id % 9000 AS STRING)) AS device_id,
  props
FROM {{events}}
"""

# DuckDB twin of the view, used as a CTE by the oracle SQL.
SEC_DUCKDB_SQL = f"""
select event_id,
 case when event_id%97=0 then null else concat(cast(([{FIRST_OCTETS}])[user_id%31+1] as varchar),'.',cast(user_id%256 as varchar),'.',cast((user_id*7)%256 as varchar),'.',cast((user_id*13)%254+1 as varchar)) end as source_ip,
 case when user_id%10=2 then '10.50.0.3' else concat('10.50.',cast(event_id%6 as varchar),'.',cast(event_id%254+1 as varchar)) end as destination_ip,
 case when event_id%101=0 then null
      when user_id%10<4 then make_timestamp(1704067200000000 + user_id*3600000000 + ((epoch_us(ts) - 1704067200000000) // 10000))
      when user_id%50=4 then make_timestamp(1704067200000000 + ((epoch_us(ts) - 1704067200000000) // 86400000000)*86400000000 + 82800000000 + event_id%3600*1000000)
      else ts end as timestamp,
 case when user_id%10=0 then concat('victim',cast(user_id as varchar)) when user_id%10=1 then concat('user',cast(1000+event_id%60 as varchar)) when user_id%10 in (2,3) then null else concat('u',cast(user_id as varchar)) end as username,
 case when user_id%10=2 then 'connection_attempt' when user_id%10=3 then 'http_request' when (event_type='error' or (user_id%10 in (0,1) and event_type<>'view')) then 'login_failed' else 'login_success' end as event_type,
 cast(case when user_id%10 in (2,3) then 0 when (event_type='error' or (user_id%10 in (0,1) and event_type<>'view')) then 1 else 0 end as double) as failed_attempts,
 cast(case when user_id%10=2 then 1+event_id%200 else ([22,80,443,3389])[event_id%4+1] end as double) as port,
 'tcp' as protocol,
 case when user_id%10=2 then null when user_id%10=3 then ([{PROBE_PATHS}])[event_id%11+1] else ([{NORMAL_PATHS}])[event_id%8+1] end as request_path,
 cast(case when user_id%10=2 then null when user_id%10=3 then 404 when (event_type='error' or (user_id%10 in (0,1) and event_type<>'view')) then 401 else 200 end as double) as status_code,
 cast(case when user_id%50=4 then 50000+event_id%150000 else 200+event_id%3800 end as double) as payload_size,
 concat('host-',cast(1000+event_id%9000 as varchar)) as device_id, props
from events
"""


def sec_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical security-event view over ``events`` (whole table), as a plan."""
    events = read_table(spark, sf_dir, "events")
    return spark.sql(SEC_SPARK_SQL, events=events)


def sec_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``sec`` log as a plan over ``events``: a narrow projection, nothing is stored."""
    return sec_view(spark, sf_dir)


def with_sec(sql: str) -> str:
    """Prefix a DuckDB query over ``sec`` with the fixture CTE."""
    return f"with sec as ({SEC_DUCKDB_SQL})\n{sql}"
