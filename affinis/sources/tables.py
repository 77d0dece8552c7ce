"""Small file-system helpers that work on any Hadoop-compatible path."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    jvm = spark._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark._jsc.hadoopConfiguration()), hpath


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, hpath = _open(spark, path)
    out = fs.create(hpath, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    fs, hpath = _open(spark, path)
    if not fs.exists(hpath):
        raise FileNotFoundError(path)
    rows = spark.read.text(path, wholetext=True).collect()
    return rows[0][0] if rows else ""


def delete_path(spark: SparkSession, path: str) -> None:
    fs, hpath = _open(spark, path)
    fs.delete(hpath, True)
