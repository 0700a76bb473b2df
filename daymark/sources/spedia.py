"""Exercise log in one CSV of 22 columns, partly derived from another data set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daymark.functions import security as se
from daymark.operators.labels import with_day
from daymark.schema import EVENT_COLUMNS


def read(spark: SparkSession, file: str) -> DataFrame:
    """One file or a folder of shards. Quoted fields may hold line breaks, so each is read unsplit and spread afterwards."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(file)
    return rows.repartition(spark.sparkContext.defaultParallelism)


def project(raw: DataFrame, real_only: bool = False, threshold: str = "midly", dataset: str = "spedia") -> DataFrame:
    """Canonical columns. ``real_only`` drops rows derived from the other data set; a missing decoder is kept."""
    rows = raw.filter(F.coalesce(F.col("Decoder_name") != "cert", F.lit(True))) if real_only else raw
    label = se.exercise_label(F.col("Description"), F.col("Level"), threshold)
    touched = [F.nullif(F.col(c), F.lit("")) for c in ("Command", "Url", "Filename", "Path") if c in raw.columns]
    host = F.coalesce("Agent_name", F.lit("nan"))
    own = F.col("event_id") if "event_id" in raw.columns else F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(raw.columns)])))
    return rows.select(
        own.alias("event_id"),
        F.try_to_timestamp("Timestamp").cast("timestamp_ntz").alias("timestamp"),
        F.coalesce("User", F.lit("unknown")).alias("user"),
        host.alias("src_host"),
        host.alias("dst_host"),
        se.exercise_action(F.col("Activity"), F.col("Action")).alias("action"),
        F.coalesce(*touched, F.lit("unknown")).alias("object"),
        label.alias("label"),
        F.when(label == 1, "traitor").otherwise("benign").alias("insider_type"),
        F.lit(dataset).alias("dataset"),
    ).filter("timestamp IS NOT NULL")


def load(spark: SparkSession, file: str, real_only: bool = False, threshold: str = "midly",
         dataset: str = "spedia") -> DataFrame:
    """Canonical events with ``event_id`` and ``day``. The log has no record id, so equal rows share one."""
    return with_day(project(read(spark, file), real_only, threshold, dataset)).select(*EVENT_COLUMNS, "event_id", "day")
