"""Raw columns -> the canonical event table (N-1 .. N-8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import failure_indicator
from ..functions.timeparse import parse_ts

# ---- fixed values: the canonical fields and which of them are numbers ---------------
CANONICAL_FIELDS = ["source_ip", "destination_ip", "timestamp", "username", "event_type", "failed_attempts",
                    "port", "protocol", "request_path", "status_code", "payload_size", "device_id",
                    "source_location"]
NUMERIC_FIELDS = ["failed_attempts", "port", "status_code", "payload_size"]
STRING_FIELDS = ["source_ip", "destination_ip", "username", "event_type", "protocol", "request_path",
                 "device_id", "source_location"]
# -------------------------------------------------------------------------------------
NUMBER_TEXT = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"


def to_number(c: Column, boolean: bool = False) -> Column:
    """N-2: numeric coercion, anything unparseable (or NaN) -> null; of a boolean column, 0 or 1."""
    if boolean:
        return c.cast("int").cast("double")
    s = c.cast("string")
    v = F.when(s.rlike(NUMBER_TEXT), F.trim(s).try_cast("double"))
    return F.when(~F.isnan(v), v)


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def to_canonical(raw: DataFrame, mappings: list[tuple[str, str | None]], epoch_unit: str = "auto",
                 keep: list[str] | None = None) -> DataFrame:
    """Project ``raw`` onto the canonical fields.

    ``mappings`` is ``[(column_name, mapped_field or None)]`` - the (small) result of
    matching, read once on the driver because the projection depends on it.
    ``keep`` lists key columns carried through unchanged (e.g. ``row_id``).
    """
    fields = [f for _, f in mappings if f]
    if twice := sorted({f for f in fields if fields.count(f) > 1}):
        raise ValueError(f"more than one column is mapped to {', '.join(twice)}")
    mapped = {f: c for c, f in mappings if f}
    unmapped = [c for c, f in mappings if not f]
    keep = keep or []
    boolean = {f.name for f in raw.schema.fields if f.dataType.typeName() == "boolean"}
    cols: dict[str, Column] = {}
    for f in CANONICAL_FIELDS:
        cols[f] = _q(mapped[f]) if f in mapped else F.lit(None)
    cols["timestamp"] = parse_ts(cols["timestamp"], epoch_unit) if "timestamp" in mapped \
        else F.lit(None).cast("timestamp_ntz")
    for f in NUMERIC_FIELDS:
        cols[f] = to_number(cols[f], mapped[f] in boolean) if f in mapped else F.lit(None).cast("double")
    # N-4, N-5: what the dataset holds, in one aggregate over at most two columns
    asked = {"n": cols["failed_attempts"], **{k: _q(mapped[f]) for k, f in (("v", "failed_attempts"), ("e", "event_type"))
                                              if f in mapped}}
    has = raw.agg(*[F.count(c).alias(k) for k, c in asked.items()]).first().asDict()
    if not has["n"] and has.get("v"):
        cols["failed_attempts"] = failure_indicator(_q(mapped["failed_attempts"])).cast("double")
    elif not has["n"] and has.get("e"):
        cols["failed_attempts"] = failure_indicator(_q(mapped["event_type"])).cast("double")
    for f in STRING_FIELDS:
        cols[f] = cols[f].cast("string")
    extra = (F.to_json(F.struct(*[_q(c).alias(c) for c in unmapped]), {"ignoreNullFields": "false"})
             if unmapped else F.lit("{}"))
    return raw.select(*[_q(k) for k in keep], *[cols[f].alias(f) for f in CANONICAL_FIELDS],
                      extra.alias("extra_fields"))


def mapping_summary(mappings: DataFrame, profiles: DataFrame) -> DataFrame:
    """N-8: field, confidence, source, dtype and first three samples per column."""
    return mappings.join(profiles, ["dataset_id", "column_name"]).select(
        "dataset_id", "column_name", "mapped_field", "confidence", "source", "inferred_dtype",
        F.slice("sample_values", 1, 3).alias("sample_values"))
