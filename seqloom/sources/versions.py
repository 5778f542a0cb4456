"""Tables that are replaced as a whole: a folder for each version, and one small file that names the current one.

A new version is written beside the old one; only then the pointer is renamed
over, in one step of the file system.  A write that fails changes nothing.
The version before stays as a backup, so a frame that reads it goes on
reading the same rows; older ones go.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

POINTER = "_current"


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _named(spark: SparkSession, path: str) -> list[str]:
    """The current version and the one before, as far as there are any."""
    jvm, fs, where = _files(spark, f"{path}/{POINTER}")
    if not fs.exists(where):
        return []
    stream = fs.open(where)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split()
    finally:
        stream.close()


def current(spark: SparkSession, path: str, backup: bool = False) -> str:
    """The folder to read: of the current version, with ``backup`` of the one before; ``path`` itself where no version was published."""
    names = _named(spark, path)
    if not names and not backup:
        return path
    if len(names) <= backup:
        raise FileNotFoundError(f"no such version of {path}")
    return f"{path}/{names[backup]}"


def publish(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """``write`` a new version to the folder that it is given, then make it the current one."""
    names, version = _named(spark, path), f"v-{uuid.uuid4().hex}"
    write(f"{path}/{version}")
    jvm, fs, pointer = _files(spark, f"{path}/{POINTER}")
    new = jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}-{version}")
    stream = fs.create(new)
    stream.write(bytearray("\n".join([version, *names[:1]]).encode()))
    stream.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(new, pointer, how)
    for old in names[1:]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/{old}"), True)


def restore(spark: SparkSession, path: str) -> None:
    """Makes the backup the current version again; the two change places."""
    now, before = current(spark, path), current(spark, path, backup=True)
    jvm, fs, _ = _files(spark, path)

    def again(folder: str) -> None:
        util, conf = jvm.org.apache.hadoop.fs.FileUtil, spark.sparkContext._jsc.hadoopConfiguration()
        util.copy(fs, jvm.org.apache.hadoop.fs.Path(before), fs, jvm.org.apache.hadoop.fs.Path(folder), False, conf)

    publish(spark, path, again)
    assert current(spark, path, backup=True) == now
