"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a side that is broadcast (of a few short columns: tens of MB).
BROADCAST_ROWS = 1_000_000
#: Spark's setting that removes an action's shuffle files when it ends; else they stay until the driver collects its garbage.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir. Only a local session without that setting takes a temporary folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The table, computed once and written to the shared folder; what reads it survives a lost executor.

    The shuffle files that it took go as soon as it is written.
    """
    path, conf = shared_folder(df.sparkSession, name), df.sparkSession.conf
    held = conf.get(CLEANED, None)
    conf.set(CLEANED, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.unset(CLEANED) if held is None else conf.set(CLEANED, held)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hints a broadcast if a stored table has at most `limit` rows; else Spark shuffles."""
    return F.broadcast(df) if df.count() <= limit else df
