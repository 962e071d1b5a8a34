"""Folders and small files on whatever file system a path names, through the cluster's own file system layer.

The layer is reached through the driver's JVM, which classic sessions have and Spark Connect sessions do not.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _at(spark, path)
    return system.exists(where)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it does not exist."""
    system, where = _at(spark, path)
    return [s.getPath().getName() for s in system.listStatus(where)] if system.exists(where) else []


def remove(spark: SparkSession, path: str) -> None:
    system, where = _at(spark, path)
    system.delete(where, True)


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Give a file or folder another name, which must be free. One step on HDFS and on local disks."""
    system, start = _at(spark, source)
    _, end = _at(spark, target)
    if system.exists(end):
        raise FileExistsError(target)
    system.mkdirs(end.getParent())
    if not system.rename(start, end):
        raise OSError(f"{source} could not be renamed to {target}")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there as a whole or not at all: written under a hidden name, then renamed."""
    folder, name = path.rsplit("/", 1)
    hidden = f"{folder}/.{name}-{uuid.uuid4().hex}"
    system, where = _at(spark, hidden)
    stream = system.create(where, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    try:
        rename(spark, hidden, path)
    except Exception:
        remove(spark, hidden)
        raise


def read_text(spark: SparkSession, path: str) -> str:
    system, where = _at(spark, path)
    stream = system.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
