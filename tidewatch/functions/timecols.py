"""Timestamp <-> epoch-microsecond helpers that do not depend on the session zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def epoch_us(col: Column | str) -> Column:
    """Microseconds since 1970-01-01 of a timestamp read as wall-clock (NTZ) time."""
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH_NTZ), _c(col).cast("timestamp_ntz"))


def from_epoch_us(col: Column | str) -> Column:
    """Inverse of :func:`epoch_us`; returns TIMESTAMP_NTZ."""
    return F.timestamp_add("MICROSECOND", _c(col), F.expr(_EPOCH_NTZ))
