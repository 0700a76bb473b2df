"""The analytic tables seen as security events of four domains.

``events`` gives the domains ev0, ev1, ev2 (by user number) and ``lineitem`` with ``orders`` gives
``retail``. Every row of the tables becomes one event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daymark.functions import timeparts as tp

EV_ACTIONS = {
    "click": "http", "view": "file_read", "purchase": "file_write", "signup": "logon", "error": "auth",
}
RETAIL_ACTIONS = {"1": "email_send", "2": "logon", "3": "http", "4": "file_write", "5": "auth"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lookup(values: dict[str, str], key):
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def ev_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", r"(\d+)", 1).cast("long")
    return e.select(
        F.concat(F.lit("ev"), F.col("user_id") % 3).alias("dataset"),
        F.col("event_id").cast("string").alias("event_id"),
        F.col("ts").cast("timestamp_ntz").alias("timestamp"),
        F.concat(F.lit("u"), "user_id").alias("user"),
        F.concat(F.lit("h"), F.col("user_id") % 20).alias("src_host"),
        F.concat(F.lit("h"), k % 20).alias("dst_host"),
        _lookup(EV_ACTIONS, F.col("event_type")).alias("action"),
        F.col("props").alias("object"),
        ((F.col("value") >= 100) & (F.col("user_id") % 10 == 3)).alias("is_positive"),
        F.col("value"),
    )


def retail_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    l = table(spark, sf_dir, "lineitem")
    action = F.when(F.col("l_returnflag") == "R", "file_delete").otherwise(
        _lookup(RETAIL_ACTIONS, F.substring("o_orderpriority", 1, 1))
    )
    return l.join(o, l.l_orderkey == o.o_orderkey).select(
        F.lit("retail").alias("dataset"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("event_id"),
        (
            F.col("o_orderdate").cast("timestamp_ntz")
            + F.make_dt_interval(F.lit(0), F.col("l_linenumber") * 3)
        ).alias("timestamp"),
        F.concat(F.lit("c"), "o_custkey").alias("user"),
        F.concat(F.lit("h"), F.col("o_custkey") % 20).alias("src_host"),
        F.concat(F.lit("s"), F.col("l_suppkey") % 20).alias("dst_host"),
        action.alias("action"),
        F.col("l_partkey").cast("string").alias("object"),
        ((F.col("l_discount") >= 0.09) & (F.col("l_quantity") >= 35) & (F.col("o_custkey") % 10 == 3)).alias(
            "is_positive"
        ),
        F.col("l_quantity").alias("value"),
    )


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four domains before labelling, with the day of each event."""
    both = ev_events(spark, sf_dir).unionByName(retail_events(spark, sf_dir))
    return both.withColumn("day", tp.day(F.col("timestamp")))


def label_keys(raw: DataFrame) -> DataFrame:
    """Distinct (dataset, user, day) holding a positive event."""
    return raw.filter("is_positive").select("dataset", "user", "day").distinct()


def roster(raw: DataFrame) -> DataFrame:
    """Distinct users of the label key table."""
    return raw.filter("is_positive").select("dataset", "user").distinct()


def intervals(raw: DataFrame) -> DataFrame:
    """One hour either side of each very large ``ev`` event, on its target host."""
    hour = F.expr("INTERVAL '1' HOUR")
    return raw.filter((F.col("dataset") != "retail") & (F.col("value") >= 250)).select(
        F.col("dst_host").alias("host"),
        (F.col("timestamp") - hour).alias("start"),
        (F.col("timestamp") + hour).alias("end"),
    )
