"""Parquet caches of events and features, and the sinks of predictions and result rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daymark.operators.features import align_features
from daymark.sources.files import exists


def cache_name(domain: str, fraction: float) -> str:
    """Folder name that carries the sampling fraction in percent."""
    return f"events_{domain}_bf{round(fraction * 100):03d}"


def table_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(jvm.org.apache.hadoop.fs.Path(target, "_SUCCESS")))


def cached_events(spark: SparkSession, root: str, domain: str, fraction: float,
                  build: Callable[[], DataFrame], grain: str = "day") -> DataFrame:
    """Events of a domain from its cache, building the cache on the first call.

    Partitioned by domain and ``day`` (or ``month`` for long, thin histories), so that domain and date filters
    prune files. Rebalancing gathers small days and splits a day that outgrows a task. On a hit the label counts
    are checked again: a cache without positives is refused.
    """
    path = f"{root.rstrip('/')}/{cache_name(domain, fraction)}"
    if not table_exists(spark, path):
        events = build().withColumn("day", F.to_date("timestamp"))
        events = events.withColumn("month", F.date_format("day", "yyyy-MM")) if grain == "month" else events
        (
            events.hint("rebalance", "dataset", grain)
            .write.partitionBy("dataset", grain)
            .mode("overwrite")
            .parquet(path)
        )
    events = spark.read.parquet(path)
    hit = events.agg(F.sum("label").alias("n_pos"), F.count_if((F.col("label") == 1) & (F.col("user") != "")).alias("u")).first()
    if not hit["n_pos"] or not hit["u"]:
        raise ValueError(f"cached events at {path} hold no positive event")
    return events


def write_features(features: DataFrame, path: str) -> None:
    features.write.partitionBy("dataset").mode("overwrite").parquet(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Cached features in the fixed column order; a missing column is an error."""
    return align_features(spark.read.parquet(path))


def write_predictions(predictions: DataFrame, path: str, fmt: str = "parquet",
                      cell: Sequence[str] = ("model", "source", "target", "seed")) -> None:
    """Prediction rows (user, day, score, label) in one folder per cell. A cell that is written again replaces its rows; others stay."""
    writer = predictions.select(*cell, "user", "day", "score", "label").write.partitionBy(*cell)
    writer = writer.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt}")


def append_rows(existing: DataFrame | None, rows: DataFrame) -> DataFrame:
    """Result rows under the union of both column sets."""
    return rows if existing is None else existing.unionByName(rows, allowMissingColumns=True)


def read_table_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None where nothing was written yet; a table that cannot be read is an error."""
    return spark.read.parquet(path) if exists(spark, path) else None
