"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing Parquet under ``spark.checkpoint.dir``: the data
outlives a lost executor.  The setting is read from the session; a folder of
our own is used only where it is unset (local runs and tests).
"""

from __future__ import annotations

import atexit
import getpass
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


#: At most so often the driver's JVM is asked to collect what finished jobs left.
GC_SECONDS = 3.0
_collected = [0.0]


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    own = spark.sparkContext.getCheckpointDir()
    if own:
        return own
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/checkpoints-{getpass.getuser()}"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone at exit; the folder is then left to its owner
        pass


def forget_at_exit(spark: SparkSession, path: str) -> None:
    """Removes a folder when the session's process ends."""
    atexit.register(_remove, spark, path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return a frame that reads the written copy."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/seqloom-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)
    forget_at_exit(spark, path)
    if time.monotonic() - _collected[0] > GC_SECONDS:
        spark.sparkContext._jvm.System.gc()  # lets Spark delete the shuffle files of finished jobs
        _collected[0] = time.monotonic()
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table that ``materialize`` wrote and that no frame in use reads any more."""
    path = getattr(df, "_scratch_path", None)
    if path:
        _remove(df.sparkSession, path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
