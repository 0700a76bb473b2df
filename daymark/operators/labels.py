"""Joins that attach labels, rosters, intervals and principals to events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daymark.functions import timeparts as tp
from daymark.schema import USER_DAY_KEY


def attach_labels(events: DataFrame, keys: DataFrame, insider_type: str = "traitor") -> DataFrame:
    """Event label and insider type by membership of (dataset, user, day) in the key table."""
    flags = keys.select(*USER_DAY_KEY).distinct().withColumn("_hit", F.lit(1))
    hit = F.col("_hit").isNotNull()
    return (
        events.join(flags, USER_DAY_KEY, "left")
        .withColumn("label", hit.cast("int"))
        .withColumn("insider_type", F.when(hit, insider_type).otherwise("benign"))
        .drop("_hit")
    )


def flag_roster(events: DataFrame, roster: DataFrame, flag: str = "on_roster") -> DataFrame:
    """Boolean column: the event's user is on the roster of its domain."""
    users = roster.select("dataset", "user").distinct().withColumn("_hit", F.lit(True))
    return (
        events.join(users, ["dataset", "user"], "left")
        .withColumn(flag, F.col("_hit").isNotNull())
        .drop("_hit")
    )


def interval_hours(intervals: DataFrame) -> DataFrame:
    """Per host and clock hour: the disjoint stretches covered by the intervals, as an array of (start, end).

    Cutting intervals at clock hours turns the range join into an equi-join on (host, hour). Overlapping
    intervals are merged first, so the array stays short however often an hour is listed.
    """
    lo = F.date_trunc("hour", F.col("start")).cast("timestamp_ntz")
    hi = F.date_trunc("hour", F.col("end")).cast("timestamp_ntz")
    cells = intervals.select(
        "host", "start", "end", F.explode(F.sequence(lo, hi, F.expr("INTERVAL '1' HOUR"))).alias("clock_hour")
    ).distinct()
    w = Window.partitionBy("host", "clock_hour").orderBy("start", "end")
    reached = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce((F.col("start") > reached).cast("int"), F.lit(1))
    islands = cells.withColumn("_opens", opens).withColumn("_island", F.sum("_opens").over(w))
    merged = islands.groupBy("host", "clock_hour", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return merged.groupBy("host", "clock_hour").agg(F.collect_list(F.struct("start", "end")).alias("stretches"))


def flag_intervals(events: DataFrame, intervals: DataFrame, host: str = "src_host", flag: str = "in_interval") -> DataFrame:
    """Boolean column: the event's host and time fall in a label interval, both ends included.

    An event meets at most one row of the cut intervals, so none is doubled.
    """
    spans = interval_hours(intervals).withColumnRenamed("host", "_host").withColumnRenamed("clock_hour", "_hour")
    hour = F.date_trunc("hour", F.col("timestamp")).cast("timestamp_ntz")
    joined = events.join(spans, (events[host] == spans["_host"]) & (hour == spans["_hour"]), "left")
    time = F.col("timestamp")
    inside = F.exists("stretches", lambda s: (s["start"] <= time) & (time <= s["end"]))
    return joined.withColumn(flag, F.coalesce(inside, F.lit(False))).drop("_host", "_hour", "stretches")


def in_interval(events: DataFrame, intervals: DataFrame, host: str = "src_host") -> DataFrame:
    """Only the events inside a label interval, each once."""
    return flag_intervals(events, intervals, host, "_inside").filter("_inside").drop("_inside")


def dominant_users(logons: DataFrame, host: str = "src_host") -> DataFrame:
    """Most frequent user per (host, day); ties go to the smallest name.

    Counts first, so the shuffle carries one row per (host, day, user); ``min_by`` then keeps one row
    per group without sorting it.
    """
    counts = logons.groupBy(F.col(host).alias("host"), "day", "user").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("host", "day").agg(
        F.min_by("user", F.struct((-F.col("n")).alias("n"), F.col("user"))).alias("dominant_user"),
        F.max("n").alias("n_logons"),
    )


def attribute_users(events: DataFrame, dominant: DataFrame, host: str = "src_host", user: str = "user") -> DataFrame:
    """Fill an empty user by the host-day's dominant user, else by ``host:<host>``; records how."""
    has_user = F.coalesce(F.col(user), F.lit("")) != ""
    d = dominant.select(F.col("host").alias(host), "day", "dominant_user")
    return (
        events.join(d, [host, "day"], "left")
        .withColumn(
            "attribution",
            F.when(has_user, "direct").when(F.col("dominant_user").isNotNull(), "dom").otherwise("pseudo"),
        )
        .withColumn(
            user,
            F.when(has_user, F.col(user)).otherwise(
                F.coalesce("dominant_user", F.concat(F.lit("host:"), F.col(host)))
            ),
        )
        .drop("dominant_user")
    )


def record_labels(events: DataFrame, ids: DataFrame, id_column: str = "event_id") -> DataFrame:
    """Label 1 for the record ids of a list."""
    flags = ids.select(id_column).distinct().withColumn("_hit", F.lit(1))
    return events.join(flags, id_column, "left").withColumn("label", F.col("_hit").isNotNull().cast("int")).drop("_hit")


def with_day(events: DataFrame) -> DataFrame:
    return events.withColumn("day", tp.day(F.col("timestamp")))


def last_by_key(rows: DataFrame, key: list[str], priority: list) -> DataFrame:
    """One row per key: the last one by ``priority``."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(p) if isinstance(p, str) else p for p in priority])
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
