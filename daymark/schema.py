"""Canonical event schema, action vocabulary and domain metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("user", T.StringType()),
        T.StructField("src_host", T.StringType()),
        T.StructField("dst_host", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("object", T.StringType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("insider_type", T.StringType()),
        T.StructField("dataset", T.StringType()),
    ]
)
EVENT_COLUMNS = EVENT_SCHEMA.fieldNames()

# The action vocabulary; the position is the action id.
ACTIONS = [
    "logon", "logoff", "auth", "file_read", "file_write", "file_delete",
    "usb_connect", "usb_disconnect", "http", "email_send", "email_recv",
    "cmd_exec", "ssh", "ftp", "process_start", "unknown",
]

# What is known about each data source.
DOMAINS = [
    ("cert", False, True, ["traitor"]),
    ("lanl", True, False, ["masquerader"]),
    ("optc", True, False, ["apt_redteam"]),
    ("twos", True, False, ["masquerader", "traitor"]),
    ("spedia", True, True, ["traitor", "masquerader"]),
]
DOMAIN_SCHEMA = "dataset string, is_real boolean, has_cert_overlap boolean, insider_types array<string>"

COUNT_COLUMNS = [f"cnt_{a}" for a in ACTIONS]
INTEGER_COLUMNS = COUNT_COLUMNS + ["n_events", "n_distinct_hosts"]
BASE_COLUMNS = INTEGER_COLUMNS + ["frac_offhours", "hour_mean", "hour_std"]
DEV_COLUMNS = [f"dev_{c}" for c in BASE_COLUMNS]
FEATURE_COLUMNS = BASE_COLUMNS + DEV_COLUMNS

USER_KEY = ["dataset", "user"]
USER_DAY_KEY = ["dataset", "user", "day"]


def action_id(action: Column) -> Column:
    """Position of an action in the vocabulary; null for anything else."""
    return F.nullif(F.array_position(F.array(*[F.lit(a) for a in ACTIONS]), action), F.lit(0)) - 1


def domain_metadata(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DOMAINS, DOMAIN_SCHEMA)


def off_vocabulary(events: DataFrame, column: str = "action") -> DataFrame:
    """Actions outside the vocabulary with their number of rows."""
    return (
        events.filter(~F.coalesce(F.col(column).isin(ACTIONS), F.lit(False)))
        .groupBy(F.col(column).alias("action"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def validate(events: DataFrame) -> DataFrame:
    """Return ``events`` unchanged, or raise on missing columns or off-vocabulary actions."""
    missing = [c for c in EVENT_COLUMNS if c not in events.columns]
    if missing:
        raise ValueError(f"missing canonical columns: {missing}")
    bad = [r["action"] for r in off_vocabulary(events).orderBy(F.desc("n_rows")).limit(20).collect()]
    if bad:
        raise ValueError(f"actions outside the vocabulary: {sorted(map(str, bad))}")
    return events
