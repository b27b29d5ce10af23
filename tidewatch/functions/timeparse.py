"""Mixed-format timestamp parsing (N-3); bad values -> null. Result is TIMESTAMP_NTZ (UTC wall clock)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: accepted layouts besides ISO-8601 (month first) ---------------
FORMATS = ("MM/dd/yyyy hh:mm:ss a", "MM/dd/yyyy h:mm:ss a", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm",
           "MM/dd/yyyy", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd", "dd/MMM/yyyy:HH:mm:ss Z",
           "yyyy-MM-dd HH:mm:ss.SSSSSS", "MMM d yyyy HH:mm:ss", "MMM d, yyyy HH:mm:ss", "MMM d, yyyy", "MMM d yyyy",
           "d MMM yyyy HH:mm:ss", "d MMM yyyy", "MM-dd-yyyy HH:mm:ss", "MM-dd-yyyy HH:mm", "MM-dd-yyyy",
           "yyyyMMdd'T'HHmmss", "yyyy-MM-dd hh:mm:ss a", "yyyy-MM-dd hh:mm a", "MM/dd/yyyy hh:mm a",
           "d MMM yyyy HH:mm:ss z")
# a value must carry a date to be parsed (bare '2026' or '12:30' are not timestamps)
DATE_SHAPE = (r"(\d{4}[-/]\d{1,2}[-/]\d{1,2})|(\d{1,2}[-/]\d{1,2}[-/]\d{4})|(\d{1,2}/[A-Za-z]{3}/\d{4})"
              r"|([A-Za-z]{3} \d{1,2},? \d{4})|(\d{1,2} [A-Za-z]{3} \d{4})|(^\d{8}T\d{6})")
WEEKDAY = r"^(Mon|Tue|Wed|Thu|Fri|Sat|Sun),\s+"
NUMERIC = r"^\s*-?\d+(\.\d+)?\s*$"
# -----------------------------------------------------------------------------------


def epoch_to_ts(num: Column, unit: str = "auto") -> Column:
    """Epoch number -> TIMESTAMP_NTZ; ``auto`` picks s/ms/us/ns by magnitude, ``ns`` mirrors pandas."""
    a = F.abs(num)
    scale = {"s": 1e6, "ms": 1e3, "us": 1.0, "ns": 1e-3}
    if unit == "auto":
        us = (F.when(a >= 1e17, num * 1e-3).when(a >= 1e14, num).when(a >= 1e11, num * 1e3)
               .otherwise(num * 1e6))
    else:
        us = num * scale[unit]
    return F.timestamp_micros(us.cast("long")).cast("timestamp_ntz")


def parse_ts(col: Column, epoch_unit: str = "auto") -> Column:
    s = F.regexp_replace(F.trim(col.cast("string")), WEEKDAY, "")
    parsed = F.coalesce(F.try_to_timestamp(s), *[F.try_to_timestamp(s, F.lit(f)) for f in FORMATS])
    text = F.when(s.rlike(DATE_SHAPE), parsed.cast("timestamp_ntz"))
    num = F.when(s.rlike(NUMERIC), epoch_to_ts(s.try_cast("double"), epoch_unit))
    return F.coalesce(num, text)
