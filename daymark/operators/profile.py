"""Summaries of event and user-day tables, and checks against label keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daymark.functions import timeparts as tp
from daymark.operators.ordered import attach_groups
from daymark.schema import USER_DAY_KEY


def graph_summary(events: DataFrame) -> DataFrame:
    """Per domain: users, hosts, edges, malicious edges, mean degrees and time span."""
    us = tp.micros(F.col("timestamp"))
    edges = events.groupBy("dataset").agg(
        F.count_distinct("user").alias("n_users"),
        F.count_distinct("dst_host").alias("_dst"),
        F.count(F.lit(1)).alias("n_edges"),
        F.sum("label").alias("n_malicious"),
        ((F.max(us) - F.min(us)) / F.lit(86_400_000_000.0)).alias("span_days"),
    )
    hosts = (
        events.select("dataset", F.explode(F.array("src_host", "dst_host")).alias("h"))
        .groupBy("dataset")
        .agg(F.count_distinct("h").alias("n_hosts"))
    )
    return edges.join(hosts, "dataset").select(
        "dataset", "n_users", "n_hosts", "n_edges", "n_malicious",
        (F.col("n_malicious") / F.col("n_edges")).alias("malicious_rate"),
        (F.col("n_edges") / F.col("n_users")).alias("mean_user_degree"),
        (F.col("n_edges") / F.col("_dst")).alias("mean_host_degree"),
        "span_days",
    )


def target_statistics(user_days: DataFrame) -> DataFrame:
    return user_days.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("n_pos"), F.avg("label").alias("base_rate")
    )


def domain_manifest(events: DataFrame) -> DataFrame:
    """Events, positives, users, user-days and the action counts of each domain.

    One pass folds the events to (user-day, action) counts; the rest works on those.
    """
    folded = events.groupBy(*USER_DAY_KEY, "action").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("p"), F.max("label").alias("label")
    )
    totals = folded.groupBy(*USER_DAY_KEY).agg(
        F.sum("n").alias("n"), F.sum("p").alias("p"), F.max("label").alias("label")
    ).groupBy("dataset").agg(
        F.sum("n").alias("events"),
        F.sum("p").alias("positive_events"),
        F.count_distinct("user").alias("users"),
        F.count(F.lit(1)).alias("user_days"),
        F.sum("label").cast("long").alias("positive_user_days"),
    )
    actions = folded.groupBy("dataset", "action").agg(F.sum("n").alias("n")).groupBy("dataset").agg(
        F.map_from_entries(F.collect_list(F.struct("action", "n"))).alias("action_counts")
    )
    return totals.join(actions, "dataset")


def histogram(rows: DataFrame, columns: Sequence[str], by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Counts of value combinations and their share of the group."""
    counts = rows.groupBy(*by, *columns).agg(F.count(F.lit(1)).alias("n"))
    totals = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_all"))
    joined = attach_groups(counts, totals, by)
    return joined.withColumn("share", F.col("n") / F.col("_all")).drop("_all")


def top_entries(counts: DataFrame, columns: Sequence[str], k: int = 20, by: Sequence[str] = ("dataset",)) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("n"), *columns)
    return counts.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def coverage(events: DataFrame, keys: DataFrame, roster: DataFrame) -> DataFrame:
    """Roster users and positive user-days that the events do and do not contain, and the days covered."""
    user_days = events.select(*USER_DAY_KEY).distinct()
    seen = user_days.withColumn("_seen", F.lit(1))
    key_side = keys.join(seen, USER_DAY_KEY, "left").groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_keys"), F.count("_seen").alias("n_seen")
    )
    users = user_days.select("dataset", "user").distinct().withColumn("_seen", F.lit(1))
    roster_side = roster.join(users, ["dataset", "user"], "left").groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_roster"), F.count("_seen").alias("n_present")
    )
    days = user_days.groupBy("dataset").agg(F.count_distinct("day").alias("n_days"))
    return (
        key_side.join(roster_side, "dataset")
        .join(days, "dataset", "left")
        .select(
            "dataset", "n_roster", "n_present", (F.col("n_roster") - F.col("n_present")).alias("n_missing"),
            "n_keys", "n_seen", (F.col("n_keys") - F.col("n_seen")).alias("n_keys_missing"), "n_days",
        )
    )


def field_counts(lines: DataFrame, expected: int, separator: str = ",") -> DataFrame:
    """Histogram of the number of separated fields in raw lines."""
    n = F.size(F.split("value", separator))
    return (
        lines.groupBy(n.alias("n_fields"))
        .agg(F.count(F.lit(1)).alias("n_lines"))
        .withColumn("malformed", F.col("n_fields") != expected)
    )


def evaluability(split_user_days: DataFrame, at_least: int = 50) -> DataFrame:
    """Whether a domain can be a target or a source, from user-days that carry ``part``."""
    counts = split_user_days.groupBy("dataset").agg(
        F.sum("label").alias("n_pos"),
        F.sum(F.when(F.col("part") == "test", F.col("label")).otherwise(0)).alias("n_test_pos"),
    )
    pos = F.col("n_pos")
    return counts.select(
        "dataset", "n_pos", "n_test_pos",
        ((pos >= at_least) & (F.col("n_test_pos") > 0)).alias("target_evaluable"),
        (pos == 0).alias("source_refused"),
        ((pos > 0) & (pos < at_least)).alias("source_warned"),
    )


def relative_time(events: DataFrame, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Min-max position of each event in the time range of its domain."""
    us = tp.micros(F.col("timestamp"))
    span = events.groupBy(*by).agg(F.min(us).alias("_lo"), F.max(us).alias("_hi"))
    width = F.col("_hi") - F.col("_lo")
    return (
        attach_groups(events, span, by)
        .withColumn("rel_time", F.when(width > 0, (us - F.col("_lo")) / width).otherwise(0.0))
        .drop("_lo", "_hi")
    )




def telemetry_profile(records: DataFrame, positive_ids: DataFrame) -> DataFrame:
    """Per host: principal classes, positive user-days of real users, remote flows, and a go / no-go verdict.

    Go needs at least half of the records from real users and a positive real user-day.
    """
    from daymark.functions import security as se

    fallback = F.coalesce(F.element_at("properties", "user"), F.element_at("properties", "requesting_user"))
    raw = F.coalesce(se.filled(F.col("principal")), fallback)
    empty = se.bare_user(raw) == ""
    kind = F.when(empty, "empty").when(se.is_service_account(raw), "service").otherwise("real")
    hits = positive_ids.select("event_id").distinct().withColumn("hit", F.lit(True))
    rows = records.select("host", "event_id", "day", kind.alias("kind"), se.bare_user(raw).alias("who"),
                          (F.upper("object") == "FLOW").alias("flow")).join(hits, "event_id", "left")
    real_hit = (F.col("kind") == "real") & F.col("hit")
    folded = rows.groupBy("host", "day", "who", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("flow").alias("flows"), F.count_if(real_hit).alias("hits")
    )
    total = lambda k: F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0))
    out = folded.groupBy("host").agg(
        F.sum("n").alias("n"), total("empty").alias("n_empty"), total("service").alias("n_service"),
        total("real").alias("n_real"), F.count_if(F.col("hits") > 0).alias("n_positive_user_days"),
        F.sum("flows").alias("n_remote"),
    )
    go = (F.col("n_real") >= 0.5 * F.col("n")) & (F.col("n_positive_user_days") > 0)
    return out.withColumn("real_rate", F.col("n_real") / F.col("n")).withColumn(
        "verdict", F.when(go, "GO").otherwise("NO-GO")
    )


def property_keys(records: DataFrame) -> DataFrame:
    """How often each property name occurs per object type."""
    return (
        records.select(F.upper("object").alias("object"), F.explode(F.map_keys("properties")).alias("key"))
        .groupBy("object", "key")
        .agg(F.count(F.lit(1)).alias("n"))
    )
