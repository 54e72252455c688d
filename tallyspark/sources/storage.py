"""Small things to do with paths in any store that Spark reaches."""

from __future__ import annotations

import uuid

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _at(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies directly in a folder; none if it isn't there."""
    p, fs = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = _at(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _at(spark, path)
    fs.delete(p, True)


def create(spark: SparkSession, path: str, content: str) -> bool:
    """Write a small file at once: beside, then renamed to where nothing may be yet. False if there is a file already."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    target, fs = _at(spark, path)
    beside = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    fs.mkdirs(target.getParent())
    stream = fs.create(beside, False)
    try:
        stream.write(bytearray(content.encode()))
    finally:
        stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(beside), fs.makeQualified(target), gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))  # without options it doesn't overwrite
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in e.java_exception.toString():
            raise
        fs.delete(beside, False)
        return False
    return True
