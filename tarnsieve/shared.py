"""The folder that all executors share: lineage is cut there, and tables between steps lie there."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which the small side of a join is broadcast; beyond, the join shuffles.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it in spark.checkpoint.dir.

    Only a local session that names none gets a folder of its own (tests); on a cluster that is an error, since an
    executor's own disk goes with the executor.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        named = sc.getCheckpointDir()
        if named:
            return named
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tarnsieve-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A new path under the shared folder."""
    return os.path.join(shared_dir(spark), f"{what}-{uuid.uuid4().hex}")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that fresh_dir() named, with all in it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder: what follows neither repeats the work nor depends on one executor's disk."""
    shared_dir(df.sparkSession)
    return df.checkpoint(True)


def sized(table: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """table as the small side of a join: broadcast where its counted size allows it, else merged after a shuffle.

    It is counted first, so it should be cut(), or cheap. Either way the optimizer, which knows no size of a table made
    of rows and too small a one of exploded columns, doesn't broadcast the other side.
    """
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in table.dtypes if kind == "string"]
    size = table.agg(F.sum(sum(texts, F.lit(16 * (1 + len(table.columns)))))).first()[0] or 0
    return F.broadcast(table) if size <= limit else table.hint("merge")
