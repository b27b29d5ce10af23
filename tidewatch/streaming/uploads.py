"""Uploads as a stream: every new log file landing in a folder is analysed (E1).

The reference analyses one uploaded file per request. Here the landing folder
is a Structured Streaming file source (paths only, ``binaryFile`` without the
content column); each micro-batch holds at most ``max_files`` new paths, and
``foreachBatch`` runs the batch pipeline once per file, writing the shared
lake tables. Progress lives in the checkpoint folder, so a restarted job
resumes after the last analysed file.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.pipeline import analyse_file


def dataset_id_for(path: str) -> str:
    return os.path.splitext(os.path.basename(path))[0]


def watch_uploads(spark: SparkSession, landing: str, root: str, checkpoint: str, max_files: int = 10,
                  once: bool = False):
    """Start the watcher; returns the StreamingQuery (``once=True`` processes what is there and stops)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = (spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.{csv,json}")
             .option("maxFilesPerTrigger", max_files).load(landing).select("path"))

    def run(batch: DataFrame, _epoch: int) -> None:
        for r in batch.select(F.regexp_replace("path", "^file:", "").alias("p")).collect():   # <= max_files
            analyse_file(spark, r["p"], root, dataset_id_for(r["p"]))

    w = files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if once else w.trigger(processingTime="30 seconds")
    return w.start()
