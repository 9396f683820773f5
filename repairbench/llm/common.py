"""Shared helpers: scratch tables in the cluster's shared folder, size-checked broadcasts, Arrow access."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a side that may be broadcast (of a few fixed-width columns each: tens of MB).
BROADCAST_ROWS = 1_000_000
#: Bytes of an Arrow batch (a longer text is a batch of its own).
BATCH_BYTES = 2 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows hold whole texts."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches to Python workers end at this many bytes, as texts may be long; a setting of this session."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def tidied(work):
    """Work on the batches of a task that gives free memory back to the system when they end.

    Python workers serve tasks of many stages; without this each keeps the most that any stage has needed.
    """

    @wraps(work)
    def run(batches, *args, **named):
        yield from work(batches, *args, **named)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
        if trim:
            trim(0)

    return run


class Scratch:
    """Written tables that cut lineage. They lie in spark.checkpoint.dir, which all executors share.

    Only a local session without that setting falls back to a temporary folder of its own.
    """

    def __init__(self, spark: SparkSession, name: str):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        self.spark, self.root = spark, f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def save(self, df: DataFrame) -> DataFrame:
        """Writes a table and returns the DataFrame that reads it."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Removes a table that is no longer read."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hints a broadcast if the (materialised) side has at most `limit` rows; else Spark shuffles."""
    return F.broadcast(df) if df.count() <= limit else df


def free_name(name: str, *frames: DataFrame) -> str:
    """A column name that none of the tables has."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bytes_list(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of an Arrow string column."""
    return column.cast(pa.large_binary()).to_pylist()


def chunks(texts: list[bytes | None], most: int = 1 << 18):
    """Ranges (start, end) of consecutive texts of about `most` bytes together, at least one text each."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t or b"") + 1
        if total >= most:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
