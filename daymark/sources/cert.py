"""Company activity logs in one CSV per channel, with answer files that list the malicious records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daymark.functions import security as se
from daymark.operators.labels import attach_labels, flag_roster, with_day
from daymark.operators.sampling import SAMPLE_SEED, keep
from daymark.schema import EVENT_COLUMNS
from daymark.sources.files import exists, glob_paths

DATE_FORMAT = "MM/dd/yyyy HH:mm:ss"

# Object column, action words and fallback action of each channel.
CHANNELS = {
    "logon": (None, se.SESSION_DEVICE_ACTIONS, "unknown", True),
    "device": (None, se.SESSION_DEVICE_ACTIONS, "unknown", True),
    "file": ("filename", se.FILE_ACTIONS, "file_write", False),
    "email": ("to", se.EMAIL_ACTIONS, "email_send", False),
    "http": ("url", {}, "http", False),
}


def event_time(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit(DATE_FORMAT)).cast("timestamp_ntz")


def read_channel(spark: SparkSession, path: str, channel: str) -> DataFrame | None:
    """All columns as text; None when the channel's file is missing.

    Only e-mail text holds line breaks inside quotes, so only that file is read unsplit.
    """
    file = f"{path.rstrip('/')}/{channel}.csv"
    if not exists(spark, file):
        return None
    reader = spark.read.option("header", True).option("escape", '"')
    return reader.option("multiLine", channel == "email").csv(file)


def project(raw: DataFrame, channel: str, dataset: str) -> DataFrame:
    """Canonical columns plus ``event_id`` of one channel's raw rows; rows with an unreadable date are dropped."""
    obj, words, fallback, needs_activity = CHANNELS[channel]
    if "activity" in raw.columns and words:
        action = se.mapped_action(F.col("activity"), words, fallback)
    elif needs_activity:
        raise ValueError(f"channel {channel} needs an activity column")
    else:
        action = F.lit(fallback)
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in raw.columns else F.lit("unknown")
    host = text("pc")
    return raw.select(
        F.col("id").alias("event_id"),
        event_time(F.col("date")).alias("timestamp"),
        F.coalesce("user", F.lit("")).alias("user"),
        host.alias("src_host"),
        host.alias("dst_host"),
        action.alias("action"),
        F.substring(text(obj), 1, se.OBJECT_LENGTH).alias("object") if obj else F.lit("unknown").alias("object"),
        F.lit(0).alias("label"),
        F.lit("benign").alias("insider_type"),
        F.lit(dataset).alias("dataset"),
    ).filter("timestamp IS NOT NULL")


def roster(spark: SparkSession, answers: str, release: str) -> DataFrame:
    """Distinct malicious users of a release."""
    rows = spark.read.option("header", True).option("escape", '"').csv(f"{answers.rstrip('/')}/insiders.csv")
    return rows.filter(F.trim("dataset") == release).select(F.trim("user").alias("user")).distinct()


def label_keys(spark: SparkSession, answers: str, release: str) -> DataFrame:
    """Distinct (user, day) of the answer files, for users on the roster.

    Rows are ragged: only the third (date) and fourth (user) fields are used, rows without them are skipped.
    """
    root = answers.rstrip("/")
    paths = glob_paths(spark, f"{root}/r{release}-*/r{release}-*-*.csv") + glob_paths(spark, f"{root}/r{release}-*.csv")
    users = roster(spark, answers, release)
    if not paths:
        return users.select("user", F.lit(None).cast("date").alias("day")).limit(0)
    rows = spark.read.schema("kind string, id string, date string, user string").option("mode", "PERMISSIVE").csv(paths)
    return (
        rows.select("user", F.to_date(event_time(F.col("date"))).alias("day"))
        .filter("user IS NOT NULL AND day IS NOT NULL")
        .join(users, "user", "left_semi")
        .distinct()
    )


def load(spark: SparkSession, path: str, release: str = "4.2", answers: str | None = None,
         sources: Sequence[str] = ("logon", "device", "file", "email"), http: str = "skip", http_rows: int = 5_000_000,
         http_fraction: float = 0.05, seed: int = SAMPLE_SEED, dataset: str = "cert") -> DataFrame:
    """Canonical events of one release.

    ``http`` is ``skip``, ``all``, ``head`` (first ``http_rows`` in time), ``uniform`` (label-blind sample) or
    ``roster`` (superseded: roster users whole, the rest sampled). Labels are joined after sampling.
    """
    answers = answers or f"{path.rstrip('/')}/answers"
    parts = []
    for channel in sources:
        raw = read_channel(spark, path, channel)
        if raw is not None:
            parts.append(project(raw, channel, dataset))
    raw = read_channel(spark, path, "http") if http != "skip" else None
    if raw is not None:
        web = project(raw, "http", dataset)
        if http == "head":
            web = web.orderBy("timestamp", "event_id").limit(http_rows)
        elif http == "uniform":
            web = web.filter(keep(http_fraction, seed))
        elif http == "roster":
            users = roster(spark, answers, release).withColumn("dataset", F.lit(dataset))
            web = flag_roster(web, users).filter(F.col("on_roster") | keep(http_fraction, seed)).drop("on_roster")
        elif http != "all":
            raise ValueError(f"unknown http mode {http!r}")
        parts.append(web)
    if not parts:
        raise FileNotFoundError(f"no activity file under {path}")
    events = parts[0]
    for p in parts[1:]:
        events = events.unionByName(p)
    keys = label_keys(spark, answers, release).withColumn("dataset", F.lit(dataset))
    return attach_labels(with_day(events), keys).select(*EVENT_COLUMNS, "event_id", "day")


def load_releases(spark: SparkSession, releases: dict[str, tuple[str, str]], answers: str | None = None, **options) -> DataFrame:
    """Several releases as separate domains of one table."""
    out = None
    for name, (path, release) in releases.items():
        part = load(spark, path, release=release, answers=answers, dataset=name, **options)
        out = part if out is None else out.unionByName(part)
    return out
