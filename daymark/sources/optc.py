"""Host telemetry as JSON lines, labelled by time intervals on hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daymark.functions import security as se
from daymark.functions import timeparts as tp
from daymark.operators.labels import attribute_users, dominant_users, flag_intervals
from daymark.operators.sampling import SAMPLE_SEED, keep
from daymark.schema import EVENT_COLUMNS
from daymark.sources.files import exists, find_first

RECORD_SCHEMA = (
    "timestamp string, id string, hostname string, object string, action string, actorID string, principal string, "
    "properties map<string,string>"
)
# Names of the interval file and of its columns.
INTERVAL_FILES = [
    "OpTCRedTeamGroundTruth.csv", "redteam_intervals.csv", "optc_redteam_intervals.csv", "ground_truth.csv", "redteam.csv",
]
HOST_NAMES = ["hostname", "host", "src_host", "src", "sysclient"]
START_NAMES = ["start", "start_time", "begin", "start_ts", "t_start"]
END_NAMES = ["end", "end_time", "finish", "end_ts", "t_end"]
DAY_NAMES = ["day", "date"]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines of all JSON-line files; the incomplete and the network-monitor folders are left out."""
    root = path.rstrip("/")
    roots = [f"{root}/{d}" for d in ("ecar/evaluation", "ecar/benign", "evaluation", "benign")]
    roots = [r for r in roots if exists(spark, r)] or [root]
    lines = spark.read.option("recursiveFileLookup", True).text(roots)
    file = F.lower(F.col("_metadata.file_path"))
    wanted = file.rlike(r"\.jsonl?(\.gz)?$") & ~file.contains("/short/") & ~file.contains("ecar-bro")
    return lines.filter(wanted).select("value")


def parse(lines: DataFrame) -> DataFrame:
    """Records of the lines; lines that are no JSON object are dropped."""
    text = F.trim("value")
    record = F.from_json(text, RECORD_SCHEMA, {"mode": "PERMISSIVE"})
    # inline() parses each line once; a plain struct column would be parsed again for every field.
    rows = lines.filter(text.startswith("{") & text.endswith("}")).select(
        F.md5(text).alias("line_digest"), F.inline(F.array(record))
    ).filter("timestamp IS NOT NULL")
    us = tp.mixed_micros(F.col("timestamp"))
    host = F.coalesce(se.filled(F.col("hostname")), F.lit("unknown"))
    timed = rows.select(
        F.coalesce("id", "line_digest").alias("event_id"), tp.plus_micros(us).alias("timestamp"), host.alias("src_host"),
        "object", "action", "principal", F.coalesce("properties", F.create_map().cast("map<string,string>")).alias("properties"),
    ).filter("timestamp IS NOT NULL")
    short = F.coalesce(F.nullif(se.norm_host(F.col("src_host")), F.lit("")), F.col("src_host"))
    return timed.withColumn("host", short).withColumn("day", F.to_date("timestamp"))


def principal(keep_service: bool = False) -> Column:
    """Acting user: the first of five fields that names somebody."""
    names = ["user", "user_name", "requesting_user", "username"]
    fields = F.array(F.col("principal"), *[F.element_at("properties", n) for n in names])
    return se.first_principal(fields, keep_service)


def host_day_users(lines: DataFrame) -> DataFrame:
    """Dominant user per (host, day) from session logons. The text filter spares parsing the other lines."""
    sessions = parse(lines.filter(F.lower("value").contains('"user_session"'))).filter(
        (F.upper("object") == "USER_SESSION") & F.upper("action").isin(se.SESSION_LOGONS)
    )
    named = sessions.withColumn("user", principal()).filter("user <> '' AND host <> ''")
    return dominant_users(named, "host").select("host", "day", "dominant_user")


def intervals_from(table: DataFrame) -> DataFrame:
    """(host, start, end) from a table with one of the known column names; swapped ends are put right."""
    known = {c.lower().strip(): c for c in table.columns}

    def column(names: list[str]) -> Column | None:
        return next((F.col(f"`{known[n]}`") for n in names if n in known), None)

    host, start, end, day = (column(n) for n in (HOST_NAMES, START_NAMES, END_NAMES, DAY_NAMES))
    if host is None:
        raise ValueError(f"no host column among {table.columns}")
    null = F.lit(None).cast("long")
    given = start is not None and end is not None
    usable = (se.filled(start).isNotNull() & se.filled(end).isNotNull()) if given else F.lit(False)
    day_start = tp.utc_micros(F.substring(F.trim(day), 1, 10)) if day is not None else null
    lo = F.when(usable, tp.mixed_micros(start) if given else null).otherwise(day_start)
    hi = F.when(usable, tp.mixed_micros(end) if given else null).otherwise(day_start + 86_400_000_000 - 1)
    rows = table.select(se.norm_host(host).alias("host"), lo.alias("lo"), hi.alias("hi"))
    return rows.filter("host <> '' AND lo IS NOT NULL AND hi IS NOT NULL").select(
        "host", tp.plus_micros(F.least("lo", "hi")).alias("start"), tp.plus_micros(F.greatest("lo", "hi")).alias("end")
    )


def read_intervals(spark: SparkSession, path: str, file: str | None = None) -> DataFrame:
    parent = path.rstrip("/").rsplit("/", 1)[0]
    file = file or find_first(spark, path, INTERVAL_FILES) or find_first(spark, parent, INTERVAL_FILES)
    if file is None or not exists(spark, file):
        raise FileNotFoundError(f"no interval file under {path}")
    out = intervals_from(spark.read.option("header", True).option("escape", '"').csv(file))
    if out.limit(1).count() == 0:
        raise ValueError(f"{file} holds no usable interval")
    return out


def project(records: DataFrame, dominant: DataFrame, keep_service: bool = False, dataset: str = "optc") -> DataFrame:
    """Canonical columns, ``attribution`` and whatever label columns the records already carry."""
    props = F.col("properties")
    port = F.coalesce(se.filled(F.element_at(props, "dest_port")), se.filled(F.element_at(props, "dst_port")))
    named = records.withColumn("user", principal(keep_service))
    users = attribute_users(named, dominant, "host")
    return users.select(
        "event_id", "timestamp", "user", "src_host",
        se.target_host(F.col("src_host"), F.col("object"), props).alias("dst_host"),
        se.host_action(F.col("object"), F.col("action"), port).alias("action"),
        se.object_text(F.col("object"), props).alias("object"),
        F.col("in_interval").cast("int").alias("label"),
        F.when(F.col("in_interval"), "apt_redteam").otherwise("benign").alias("insider_type"),
        F.lit(dataset).alias("dataset"), "day", "attribution", "host",
    )


def events_from_lines(lines: DataFrame, intervals: DataFrame, fraction: float | None = 0.02, seed: int = SAMPLE_SEED,
                      keep_service: bool = False, dataset: str = "optc") -> DataFrame:
    """Events of the lines: all inside an interval plus a sample of the rest (``None``: everything)."""
    flagged = flag_intervals(parse(lines), intervals, "host")
    kept = flagged if fraction is None else flagged.filter(F.col("in_interval") | keep(fraction, seed))
    return project(kept, host_day_users(lines), keep_service, dataset)


def load(spark: SparkSession, path: str, intervals: str | None = None, fraction: float | None = 0.02,
         keep_service: bool = False, seed: int = SAMPLE_SEED, dataset: str = "optc") -> DataFrame:
    events = events_from_lines(read_lines(spark, path), read_intervals(spark, path, intervals), fraction, seed,
                               keep_service, dataset)
    return events.select(*EVENT_COLUMNS, "event_id", "day")


def attribution_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("attribution").agg(F.count(F.lit(1)).alias("n"))
