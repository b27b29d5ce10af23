"""Rounding and number-to-text helpers with engine-independent results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(x: Column, digits: int) -> Column:
    """Round half away from zero on the scaled double: ``round(x * 10^d) / 10^d``."""
    m = float(10 ** digits)
    return F.round(x * F.lit(m), 0) / F.lit(m)


def int_text(x: Column) -> Column:
    """``'{:.0f}'``-style text of a double (ties to even)."""
    return F.bround(x, 0).cast("long").cast("string")


def _split(a: Column) -> tuple[Column, Column]:
    c = F.lit(134217729.0) * a            # 2^27 + 1 (Dekker split)
    hi = c - (c - a)
    return hi, a - hi


def fixed_text(x: Column, digits: int) -> Column:
    """``f'{x:.{digits}f}'`` exactly as Python prints it: correctly rounded (ties to even)
    on the exact binary value of ``x``.

    ``p = x * 10^d`` is rounded; its exact error comes from Dekker's TwoProduct, and
    only when ``p`` sits exactly on a .5 tie does that error decide the direction.
    """
    scale = F.lit(float(10 ** digits))
    p = x * scale
    ah, al = _split(x)
    bh, bl = _split(scale)
    err = ((ah * bh - p) + ah * bl + al * bh) + al * bl
    fl = F.floor(p).cast("double")
    tie = (p - fl) == F.lit(0.5)
    r = F.when(tie & (err < 0), fl).when(tie & (err > 0), fl + 1.0).otherwise(F.rint(p))
    return F.format_string(f"%.{digits}f", r / scale)
