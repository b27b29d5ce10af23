"""IPv4 text -> 32-bit integer, strict (four decimal octets 0-255, no leading zeros)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4_STRICT = f"^{_OCTET}\\.{_OCTET}\\.{_OCTET}\\.{_OCTET}$"
# loose shape used by the profiler (octets not range-checked)
IPV4_SHAPE = r"^\d{1,3}(\.\d{1,3}){3}$"


def ipv4_to_long(col: Column) -> Column:
    """Null for anything that is not a strict dotted-quad IPv4 address."""
    parts = F.split(col, "\\.")
    val = F.lit(0).cast("long")
    for i in range(4):
        val = val * F.lit(256) + F.element_at(parts, i + 1).cast("long")
    return F.when(col.rlike(IPV4_STRICT), val)
