"""Upload -> analyse -> persist (E1), and re-analysis with overrides (E2, K-1 .. K-4).

Under ``root`` (a shared folder on a cluster) every run of a dataset writes
tables of its own: ``<table>/<dataset>/<version>``. Only then is the run
committed, as file ``catalog/<dataset>/<n>.json`` where n follows the commit
that the run started from. That file is renamed into place and never
overwritten, so of two runs that started from one commit one wins and the other
raises :class:`ConcurrentVersionError` and takes its tables back; a run that
fails leaves the old results in force, and two mappings never mix. Ids are
folder names as they are (quoted), so ``00123`` and ``123`` are different.

Stored files are read with the schemas below: a column that was added later is
null in older files (K-4), and so is a later key of an older catalog file.
Events are stored sorted by (source_ip, timestamp), in files that split large
sources, so a query on one source reads few row groups.
"""

from __future__ import annotations

import datetime as _dt
import json
import os
import uuid
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators.detect import spray_targets
from ..operators.geo import fill_location
from ..operators.matching import map_columns, validate_overrides
from ..operators.normalize import mapping_summary, to_canonical
from ..operators.profile import profile
from ..session import cut_lineage
from ..sources.logs import read_log, with_row_id
from .analysis import analyse
from .views import Investigation, investigate


class SourceFileMissingError(FileNotFoundError):
    pass


TABLES = ("events", "detections", "spray_targets", "alerts", "alert_evidence")
CATALOG = ("dataset_id string, version string, filename string, source_path string, uploaded_at string, row_count long, "
           "mapping_summary string, unmapped_columns string, overrides string, tables map<string,string>")


#: The stored tables' columns, whatever version wrote a file.
SCHEMAS = {
    "events": "row_id struct<file:string,block:bigint,n:bigint>, source_ip string, destination_ip string, timestamp timestamp_ntz, "
              "username string, event_type string, failed_attempts double, port double, protocol string, request_path string, "
              "status_code double, payload_size double, device_id string, source_location string, extra_fields string",
    "detections": "detection_type string, detector_order int, source_ip string, window_start timestamp_ntz, window_end timestamp_ntz, "
                  "severity double, event_count bigint, targeted_usernames array<string>, evidence_json string",
    "spray_targets": "source_ip string, username string, first_row struct<file:string,block:bigint,n:bigint>",
    "alerts": "source_ip string, event_count bigint, top_features array<struct<feature:string,value:double>>, threat_severity double, "
              "behavior_anomaly double, frequency double, confidence double, risk_score double, classification string, threat string, "
              "confidence_pct double, reason string, recommendation array<string>, country string, country_code string, city string, "
              "lat double, lon double",
    "alert_evidence": "source_ip string, detector_order int, target string, window_start timestamp_ntz, line string",
}


class ConcurrentVersionError(RuntimeError):
    """Another run of the dataset was committed since this one started."""


class OverrideError(ValueError):
    """Overrides that name unknown columns, or one field twice."""


def _path(root: str, name: str, dataset_id: str, version: str) -> str:
    return f"{root}/{name}/{quote(dataset_id, safe='')}/{version}"


def _fs(spark: SparkSession, path: str):
    """The path's file system and the path in it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(p)


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def _commits(root: str, dataset_id: str) -> str:
    return f"{root}/catalog/{quote(dataset_id, safe='')}"


def newest_commit(spark: SparkSession, root: str, dataset_id: str) -> int:
    """The number of the dataset's newest commit; 0 without any."""
    fs, p = _fs(spark, _commits(root, dataset_id))
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith(".")), default=0)


def _commit(spark: SparkSession, root: str, dataset_id: str, number: int, entry: dict) -> None:
    """Put the entry in force as commit ``number``, unless there is one."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = _commits(root, dataset_id)
    fs, written = _fs(spark, f"{at}/.{uuid.uuid4().hex}")
    out = fs.create(written, False)
    out.write((json.dumps(entry) + "\n").encode())
    out.close()
    place = _fs(spark, f"{at}/{number:012d}.json")[1]
    modes = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    modes[0] = hadoop.Options.Rename.NONE
    context = hadoop.FileContext.getFileContext(place.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(written, place, modes)     # fails if the place is taken
    except Py4JJavaError as e:
        fs.delete(written, False)
        if "FileAlreadyExists" in str(e.java_exception):
            raise ConcurrentVersionError(f"Dataset {dataset_id} has had another run committed as number {number}") from None
        raise


def analyse_file(spark: SparkSession, path: str, root: str, dataset_id: str,
                 overrides: dict[str, str | None] | None = None, fmt: str | None = None) -> dict:
    """Run the whole pipeline on one raw log and persist every stage. Returns the catalog entry."""
    overrides = dict(overrides or {})
    validate_overrides(overrides)
    base = newest_commit(spark, root, dataset_id)
    version = uuid.uuid4().hex
    at = {t: _path(root, t, dataset_id, version) for t in TABLES}
    try:
        entry = _write_version(spark, path, at, dataset_id, overrides, fmt) | {"version": version}
        _commit(spark, root, dataset_id, base + 1, entry)
    except BaseException:
        for p in at.values():       # nothing refers to them
            _delete(spark, p)
        raise
    return entry


def _write_version(spark: SparkSession, path: str, at: dict[str, str], dataset_id: str, overrides: dict[str, str | None],
                   fmt: str | None) -> dict:
    """Every stage of one run, written to the folders of ``at``; the catalog entry."""
    raw = with_row_id(read_log(spark, path, fmt))
    prof = cut_lineage(profile([(dataset_id, raw)]))
    known = {r[0] for r in prof.select("column_name").collect()}
    overrides = {k: v for k, v in overrides.items() if k in known}
    mappings = cut_lineage(map_columns(prof, {dataset_id: overrides}))
    pairs = [(r["column_name"], r["mapped_field"])
             for r in mappings.orderBy("col_index").select("column_name", "mapped_field").collect()]
    events = fill_location(to_canonical(raw, pairs, keep=["row_id"]))
    # (a source of any size is split by time over as many files as it needs)
    events.repartitionByRange("source_ip", "timestamp").sortWithinPartitions("source_ip", "timestamp").write.parquet(at["events"])
    stored = spark.read.schema(SCHEMAS["events"]).parquet(at["events"])
    avg_conf = mappings.agg(F.avg("confidence")).collect()[0][0] or 0.0
    result = analyse(stored, "row_id", float(avg_conf))
    result.detections.select("*", F.to_json("evidence").alias("evidence_json")).drop("evidence").write.parquet(at["detections"])
    result.alerts.write.parquet(at["alerts"])
    result.evidence.write.parquet(at["alert_evidence"])
    # every account of a spray, where a detection only names the first ten
    spray_targets(stored, "row_id", detections=spark.read.parquet(at["detections"])).write.parquet(at["spray_targets"])
    summary = {r["column_name"]: {"mapped_field": r["mapped_field"], "confidence": r["confidence"],
                                  "source": r["source"], "inferred_dtype": r["inferred_dtype"],
                                  "sample_values": list(r["sample_values"])}
               for r in mapping_summary(mappings, prof).collect()}
    return {"dataset_id": dataset_id, "filename": os.path.basename(path), "source_path": path,
             "uploaded_at": _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None).isoformat(timespec="microseconds"),
             "row_count": stored.count(),
             "mapping_summary": json.dumps(summary),
             "unmapped_columns": json.dumps([c for c, f in pairs if not f]),
             "overrides": json.dumps(overrides),
             "tables": at}


def reanalyse(spark: SparkSession, root: str, dataset_id: str, overrides: dict[str, str | None]) -> dict:
    """K-3: a new version from the retained file; overrides are replaced, not merged, and checked first (M-13)."""
    validate_overrides(overrides)
    old = dataset(spark, root, dataset_id)
    known = set(json.loads(old["mapping_summary"]))
    fields = [f for f in overrides.values() if f is not None]
    if bad := sorted(set(overrides) - known):
        raise OverrideError(f"Unknown column(s): {', '.join(bad)}")
    if twice := sorted({f for f in fields if fields.count(f) > 1}):
        raise OverrideError(f"Field(s) given to more than one column: {', '.join(twice)}")
    src = old["source_path"]
    fs, p = _fs(spark, src)
    if not fs.exists(p):
        raise SourceFileMissingError(f"The retained copy of '{old['filename']}' is no longer available")
    entry = analyse_file(spark, src, root, dataset_id, overrides)
    for path in old["tables"].values():      # in force no longer
        _delete(spark, path)
    return entry


def catalog(spark: SparkSession, root: str) -> DataFrame:
    """Q-13: the newest commit of each dataset, newest first."""
    rows = spark.read.schema(CATALOG).option("recursiveFileLookup", True).json(f"{root}/catalog")
    numbered = rows.withColumn("commit", F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\.json", 1).cast("long"))
    newest = numbered.groupBy("dataset_id").agg(F.max_by(F.struct(*numbered.columns), "commit").alias("r"))
    return newest.select("r.*").orderBy(F.col("uploaded_at").desc())


def dataset(spark: SparkSession, root: str, dataset_id: str) -> Row:
    """Q-13: one dataset's catalog row."""
    found = catalog(spark, root).where(F.col("dataset_id") == dataset_id).collect()
    if not found:
        raise KeyError(f"Dataset {dataset_id} not found")
    return found[0]


def schema_view(spark: SparkSession, root: str, dataset_id: str) -> DataFrame:
    """Q-13: a dataset's columns with the field, confidence, source, dtype and samples of each."""
    summary = json.loads(dataset(spark, root, dataset_id)["mapping_summary"])
    rows = [(c, m["mapped_field"], m["confidence"], m["source"], m["inferred_dtype"], m["sample_values"]) for c, m in summary.items()]
    return spark.createDataFrame(rows, "column_name string, mapped_field string, confidence double, source string, "
                                       "inferred_dtype string, sample_values array<string>")


def table(spark: SparkSession, root: str, name: str, dataset_id: str) -> DataFrame:
    """A stored table of one dataset, in the version that the catalog names."""
    return spark.read.schema(SCHEMAS[name]).parquet(dataset(spark, root, dataset_id)["tables"][name])


def all_datasets(spark: SparkSession, root: str, name: str) -> DataFrame:
    """K-4: a stored table over the versions in force of all datasets, with ``dataset_id``.

    One scan over the folders that the catalog names; columns that an older version lacks are null.
    """
    paths = [r["tables"][name] for r in catalog(spark, root).select("tables").collect() if name in (r["tables"] or {})]
    if not paths:
        return spark.createDataFrame([], f"dataset_id string, {SCHEMAS[name]}")
    rows = spark.read.schema(SCHEMAS[name]).option("recursiveFileLookup", True).parquet(*paths)
    folder = F.regexp_extract(F.col("_metadata.file_path"), rf"/{name}/([^/]+)/[^/]+/[^/]+$", 1)
    return rows.select(F.url_decode(F.url_decode(folder)).alias("dataset_id"), "*")     # quoted as a folder, then as a URI


def investigate_ip(spark: SparkSession, root: str, dataset_id: str, source_ip: str, event_limit: int = 200) -> Investigation:
    """Q-6 over a dataset's stored tables; a KeyError for a dataset or an IP without an analysis."""
    events, detections, alerts = (table(spark, root, t, dataset_id) for t in ("events", "detections", "alerts"))
    return investigate(events, detections, alerts, source_ip, "row_id", event_limit)
