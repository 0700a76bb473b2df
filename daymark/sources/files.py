"""File lookups through Hadoop's file systems, so that any storage works."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def glob_paths(spark: SparkSession, pattern: str) -> list[str]:
    fs, p = _fs(spark, pattern)
    found = fs.globStatus(p)
    return sorted(str(s.getPath()) for s in found if s.isFile()) if found else []


def find_first(spark: SparkSession, folder: str, names: list[str]) -> str | None:
    for name in names:
        path = f"{folder.rstrip('/')}/{name}"
        if exists(spark, path):
            return path
    return None
