"""Scans of files as they arrive: a file stream, each micro-batch analysed as a project of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarnsieve.config import Config
from tarnsieve.plans.engine import analyse_files
from tarnsieve.sources.tree import type_of

_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def arriving(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    """path, type, text of files that appear below folder."""
    x = spark.readStream.format("binaryFile").schema(_SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(folder)
    return x.select("path", type_of(F.col("path")).alias("type"), F.decode("content", "UTF-8").alias("text")).where("type is not null")


def watch(files: DataFrame, out: str, checkpoint: str, config: Config | None = None, once: bool = False) -> StreamingQuery:
    """Appends the findings of each micro-batch to a table at out. A batch that is repeated overwrites its own part.

    Rules over packages and files see the files of one batch alone.
    """

    def scan(batch: DataFrame, number: int) -> None:
        findings, _, _ = analyse_files(batch, config)
        findings.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(scan)
    return (writer.trigger(availableNow=True) if once else writer).start()
