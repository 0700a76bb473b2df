"""Authentication log without a header, and the list of compromised-credential records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daymark.functions import security as se
from daymark.functions import timeparts as tp
from daymark.operators.labels import attach_labels, flag_roster, with_day
from daymark.operators.sampling import SAMPLE_SEED, keep
from daymark.schema import EVENT_COLUMNS
from daymark.sources.files import find_first

START = "TIMESTAMP_NTZ'2015-01-01 00:00:00'"
AUTH_SCHEMA = (
    "time string, src_user string, dst_user string, src_comp string, dst_comp string, auth_type string, "
    "logon_type string, auth_orientation string, success string"
)
REDTEAM_SCHEMA = "time string, user string, src_comp string, dst_comp string"


def event_time(seconds: Column) -> Column:
    return tp.plus_seconds(F.trim(seconds).try_cast("double"), START)


def _read(spark: SparkSession, path: str, stem: str, schema: str) -> DataFrame:
    file = find_first(spark, path, [f"{stem}.txt.gz", f"{stem}.txt"])
    if file is None:
        raise FileNotFoundError(f"{stem}.txt[.gz] not found under {path}")
    rows = spark.read.schema(schema).csv(file)
    # A gzip file is one task; spread its rows before any further work.
    return rows.repartition(spark.sparkContext.defaultParallelism * 4) if file.endswith(".gz") else rows


def read_auth(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, "auth", AUTH_SCHEMA)


def read_redteam(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, "redteam", REDTEAM_SCHEMA)


def label_keys(redteam: DataFrame) -> DataFrame:
    """Distinct (user, day) of the compromised-credential records."""
    return redteam.select(
        se.before_at(F.col("user")).alias("user"), F.to_date(event_time(F.col("time"))).alias("day")
    ).distinct()


def project(auth: DataFrame, keep_machines: bool = False, dataset: str = "lanl") -> DataFrame:
    """Canonical columns of authentication rows; machine accounts and unreadable times are dropped.

    The log has no record id. ``event_id`` is the md5 of the whole row.
    """
    raw = ["time", "src_user", "dst_user", "src_comp", "dst_comp", "auth_type", "logon_type", "auth_orientation", "success"]
    user = se.before_at(F.coalesce("src_user", F.lit("")))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = auth if keep_machines else auth.filter(~se.is_machine_account(user))
    return rows.select(
        F.md5(F.concat_ws(",", *[text(c) for c in raw])).alias("event_id"),
        event_time(F.col("time")).alias("timestamp"),
        user.alias("user"),
        text("src_comp").alias("src_host"),
        text("dst_comp").alias("dst_host"),
        se.mapped_action(F.col("auth_orientation"), se.AUTH_ORIENTATIONS, "auth").alias("action"),
        F.substring(F.concat_ws(":", text("auth_type"), text("logon_type"), text("success")), 1, se.OBJECT_LENGTH)
        .alias("object"),
        F.lit(0).alias("label"),
        F.lit("benign").alias("insider_type"),
        F.lit(dataset).alias("dataset"),
    ).filter("timestamp IS NOT NULL")


def load(spark: SparkSession, path: str, mode: str = "uniform", fraction: float = 0.02, rows: int = 5_000_000,
         keep_machines: bool = False, seed: int = SAMPLE_SEED, dataset: str = "lanl") -> DataFrame:
    """Canonical events. ``mode``: ``all``, ``uniform``, ``roster`` (superseded) or ``head``."""
    events = project(read_auth(spark, path), keep_machines, dataset)
    keys = label_keys(read_redteam(spark, path)).withColumn("dataset", F.lit(dataset))
    if mode == "uniform":
        events = events.filter(keep(fraction, seed))
    elif mode == "roster":
        events = flag_roster(events, keys).filter(F.col("on_roster") | keep(fraction, seed)).drop("on_roster")
    elif mode == "head":
        events = events.orderBy("timestamp", "event_id").limit(rows)
    elif mode != "all":
        raise ValueError(f"unknown mode {mode!r}")
    return attach_labels(with_day(events), keys, "masquerader").select(*EVENT_COLUMNS, "event_id", "day")
