"""SparkSession construction and session-level settings the engine relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings every plan in this package assumes. Time arithmetic is done on
# TIMESTAMP_NTZ / epoch microseconds, so results do not depend on the zone,
# but a UTC session keeps printed LTZ values and bucket floors stable.
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # of a repeated key in a JSON object the last value counts, instead of the record being lost
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def get_session(master: str | None = None, app: str = "tidewatch",
                shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the engine's settings.

    On a cluster ``master`` stays None and the launcher decides; tests pass
    ``local[*]``. The web UI is off: the engine never needs it.
    """
    b = SparkSession.builder.appName(app).config("spark.ui.enabled", "false")
    if master:
        b = b.master(master)
    for k, v in ENGINE_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_engine_conf(spark)
    return spark


def apply_engine_conf(spark: SparkSession) -> SparkSession:
    """Apply the runtime-settable engine settings to an existing session."""
    for k, v in ENGINE_CONF.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # static conf on some deployments; keep theirs
            pass
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster in ``spark.checkpoint.dir``.

    Only a session on one machine (tests) may go without: it gets a temporary
    folder. On a cluster that names none this raises, as a local folder would
    not be seen by the other executors.
    """
    sc = spark.sparkContext
    d = sc._jsc.sc().getCheckpointDir()
    if d.isDefined():
        return d.get()
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="tidewatch-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return conf_dir


def cut_lineage(df):
    """Reliable checkpoint into the session's checkpoint folder (survives executor loss)
    for a small intermediate that several branches read: later plans start from a
    leaf instead of re-planning (and re-running) its whole lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
