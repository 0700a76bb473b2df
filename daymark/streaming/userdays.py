"""User-day features from arriving event files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from daymark.functions import timeparts as tp
from daymark.operators.features import _finish, host_pairs, merge_partials, partial_aggregates
from daymark.schema import ACTIONS, BASE_COLUMNS, USER_DAY_KEY


def event_stream(spark: SparkSession, path: str, like: DataFrame, files_per_batch: int | None = None) -> DataFrame:
    """Stream of canonical event files under ``path`` with the columns of ``like``."""
    reader = spark.readStream.schema(like.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def user_day_stream(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Base features of every closed day; rows later than ``lateness`` are dropped.

    Two chained aggregations: per (user, day, host), then per (user, day). The state keeps one row per host and
    no host set, so a user that touches very many hosts is spread over the state partitions.
    """
    timed = events.withColumn("event_time", F.col("timestamp").cast("timestamp")).withWatermark("event_time", lateness)
    hour = F.hour("timestamp")
    per_host = timed.groupBy(F.window("event_time", "1 day").alias("w"), "dataset", "user", "dst_host").agg(
        *[F.count_if(F.col("action") == a).alias(f"cnt_{a}") for a in ACTIONS],
        F.count(F.lit(1)).alias("n_events"),
        F.sum(tp.off_hours(hour)).alias("n_offhours"),
        F.sum(hour).alias("hour_sum"),
        F.sum(hour * hour).alias("hour_sumsq"),
    )
    sums = [*[f"cnt_{a}" for a in ACTIONS], "n_events", "n_offhours", "hour_sum", "hour_sumsq"]
    per_day = per_host.groupBy(F.window(F.window_time("w"), "1 day").alias("d"), "dataset", "user").agg(
        *[F.sum(c).alias(c) for c in sums], F.count("dst_host").alias("n_distinct_hosts")
    )
    return _finish(per_day.withColumn("day", F.to_date("d.start"))).select(*USER_DAY_KEY, *BASE_COLUMNS)


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything that has arrived, append the closed days to ``path``, and stop."""
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def partial_writer(path: str):
    """``foreachBatch`` function: partial sums and host pairs of a batch, in the folder of its batch id.

    A batch that is run again replaces its own folder, so nothing is counted twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("day", tp.day(F.col("timestamp")))
        partial_aggregates(rows).write.mode("overwrite").parquet(f"{path}/sums/batch={batch_id}")
        host_pairs(rows).write.mode("overwrite").parquet(f"{path}/hosts/batch={batch_id}")

    return write


def merge_stream(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Start folding arriving events into partials under ``path``."""
    return (
        events.writeStream.foreachBatch(partial_writer(path)).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def merged_features(spark: SparkSession, path: str, keys: Sequence[str] = USER_DAY_KEY) -> DataFrame:
    """Base features from all partials written so far."""
    return merge_partials(spark.read.parquet(f"{path}/sums"), spark.read.parquet(f"{path}/hosts"), keys)
