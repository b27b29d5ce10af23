"""Fixed values shared by detectors and normalisation, and the column rules built on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values (must equal the reference behaviour) -------------------
# Case-insensitive words that mark a textual status as a failed attempt.
FAILURE_PATTERN = "fail|denied|invalid|error|reject|refus|unauthor|forbidden|lock|bad"
# Status codes counted as error responses by the endpoint-probe rule.
ERROR_STATUS_CODES = (400, 401, 403, 404, 500)
# Lower-cased substrings that mark a request path as sensitive (literal match).
SUSPICIOUS_PATH_PATTERNS = (
    "admin", ".env", "wp-login", "phpmyadmin", ".git", "passwd", "shadow",
    ".bak", "debug", "..", "server-status", "actuator",
)
# ---------------------------------------------------------------------------


def failure_indicator(col: Column) -> Column:
    """1 when the text matches the failure words (case-insensitive), else 0; null -> 0."""
    return F.coalesce(col.cast("string").rlike("(?i)(" + FAILURE_PATTERN + ")").cast("int"), F.lit(0))


def is_error_status(col: Column) -> Column:
    return F.coalesce(col.isin(*[float(c) for c in ERROR_STATUS_CODES]), F.lit(False))


def is_suspicious_path(col: Column) -> Column:
    low = F.lower(col)
    cond = None
    for p in SUSPICIOUS_PATH_PATTERNS:
        c = F.contains(low, F.lit(p))
        cond = c if cond is None else (cond | c)
    return F.coalesce(cond, F.lit(False))


def sql_in_list(values) -> str:
    """Render values as a SQL IN-list body (for the oracle twins)."""
    return ", ".join(f"'{v}'" if isinstance(v, str) else repr(v) for v in values)
