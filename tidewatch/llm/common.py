"""Helpers shared by the operators: table access, worker state, text splitting, lineage cuts."""

from __future__ import annotations

import re
import sys
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir

#: The words of every operator: runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_SPACE = re.compile(SPACE)
_ODD = re.compile("[\x1c-\x1f\x85\xa0  -     　]")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def worker_state(name: str) -> dict:
    """A dict that lives as long as this Python worker.

    Functions are pickled by value, so a module global would be new in every
    task; a worker that is reused keeps what it has learned about words here.
    """
    home = sys.modules.setdefault("tidewatch_worker_state", types.ModuleType("tidewatch_worker_state"))
    return home.__dict__.setdefault(name, {})


def words_of(text: str | None) -> list[str]:
    """The words of a text, split at ASCII white space alone."""
    if not text:
        return []
    if _ODD.search(text):  # str.split would cut here too
        return [w for w in _SPACE.split(text) if w]
    return text.split()


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which every executor can reach; it goes when the driver ends.

    Only a session on one machine (tests) may name none; on a cluster that is an error.
    """
    at = f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    return at


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` has not got."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Later plans start from files that outlive any executor; unlike a cached
    frame nothing is recomputed when one is lost.
    """
    at = shared_dir(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Small slices of Arrow batches, so that Python holds few texts at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def slices_by_size(batches: Iterator[pa.RecordBatch], column: int, rows: int = 256, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows that end once their texts in ``column`` reach ``size`` bytes."""
    for b in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            before = int(upto[at - 1]) if at else 0
            to = min(at + rows, int(np.searchsorted(upto, before + size)) + 1, b.num_rows)
            yield b.slice(at, to - at)
            at = to


def to_arrow(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
