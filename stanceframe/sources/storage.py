"""Small files in whatever store Spark writes to (local, HDFS, object stores), by Spark's own file system layer."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none where it does not exist."""
    store, where = _path(spark, path)
    return sorted(f.getPath().getName() for f in store.listStatus(where)) if store.exists(where) else []


def read_text(spark: SparkSession, path: str) -> str:
    return "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A new file that appears whole; one of this name must not exist."""
    store, where = _path(spark, path)
    attempt = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    out = store.create(attempt)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if store.exists(where) or not store.rename(attempt, where):
        store.delete(attempt, False)
        raise FileExistsError(path)


def remove(spark: SparkSession, path: str) -> None:
    store, where = _path(spark, path)
    store.delete(where, True)
