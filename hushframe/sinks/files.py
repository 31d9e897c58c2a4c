"""Small control files through the file system that Spark writes to."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def join(*parts: str) -> str:
    return "/".join(p.rstrip("/") for p in parts)


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file that is not there yet; False if another run was first.

    As safe as the file system's own create-if-absent.
    """
    files, where = _at(spark, path)
    try:
        stream = files.create(where, False)
    except Py4JJavaError:
        if files.exists(where):
            return False
        raise
    stream.write(bytearray(text.encode()))
    stream.close()
    return True


def read_text(spark: SparkSession, path: str) -> str:
    files, where = _at(spark, path)
    stream = files.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def listed(spark: SparkSession, folder: str) -> dict[str, float]:
    """Names in a folder with the second of their last change; nothing for a folder that is not there."""
    files, where = _at(spark, folder)
    if not files.exists(where):
        return {}
    return {s.getPath().getName(): s.getModificationTime() / 1000 for s in files.listStatus(where)}


def delete(spark: SparkSession, path: str) -> None:
    files, where = _at(spark, path)
    files.delete(where, True)
