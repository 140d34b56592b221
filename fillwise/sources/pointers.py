"""Small files that say which folder of a table is live, in any store that Spark knows."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def files(spark: SparkSession, path: str):
    """(file system, path object) of Hadoop: the table may lie in any store that Spark knows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where it does not exist."""
    fs, at = files(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []


def put(spark: SparkSession, path: str, text: str) -> None:
    """Puts a small file in place by a rename: readers see it whole or not at all. One that is there stays as it is."""
    fs, at = files(spark, path)
    _, part = files(spark, f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(part, at):
        fs.delete(part, False)


def read(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path).collect())


def remove(spark: SparkSession, path: str) -> None:
    fs, at = files(spark, path)
    fs.delete(at, True)
