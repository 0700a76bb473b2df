"""Train/test splits in time and by identity. Rows get a ``part`` column; none is dropped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daymark.functions import timeparts as tp
from daymark.functions.hashing import digest
from daymark.operators.ordered import attach_groups, ranked
from daymark.session import cut


def _interpolate(lo: Column, hi: Column, weight: Column) -> Column:
    return lo + (hi - lo) * weight


def time_quantile(events: DataFrame, fraction: float, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Linear-interpolated quantile of ``timestamp`` per group, in microseconds (``cut_us``), and its first and last time.

    A count per minute finds the one or two minutes that hold the wanted positions; only their events are
    looked at again, folded to distinct microseconds. No step holds a group's events in one task.
    """
    us = tp.micros(F.col("timestamp"))
    stamped = events.select(*by, us.alias("us"), F.floor(us / 60_000_000).alias("minute"))
    per_minute = stamped.groupBy(*by, "minute").agg(
        F.count(F.lit(1)).alias("n"), F.min("us").alias("lo_us"), F.max("us").alias("hi_us")
    )
    group = Window.partitionBy(*by)
    upto = group.orderBy("minute").rowsBetween(Window.unboundedPreceding, 0)
    placed = per_minute.withColumn("after", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(group))
    placed = placed.withColumn("first_us", F.min("lo_us").over(group)).withColumn("last_us", F.max("hi_us").over(group))
    position = (F.col("total") - 1) * F.lit(fraction)
    lo_at, hi_at = F.floor(position), F.ceil(position)
    before = F.col("after") - F.col("n")
    holds = lambda at: (before <= at) & (at < F.col("after"))
    target = placed.filter(holds(lo_at) | holds(hi_at)).select(
        *by, "minute", before.alias("before"), lo_at.alias("lo_at"), hi_at.alias("hi_at"),
        (position - lo_at).alias("weight"), "first_us", "last_us",
    )
    exact = stamped.groupBy(*by, "minute", "us").agg(F.count(F.lit(1)).alias("m"))
    exact = attach_groups(exact, target, [*by, "minute"])
    inside = Window.partitionBy(*by, "minute").orderBy("us").rowsBetween(Window.unboundedPreceding, 0)
    exact = exact.withColumn("last", F.col("before") + F.sum("m").over(inside))
    covers = lambda at: (F.col("last") - F.col("m") <= F.col(at)) & (F.col(at) < F.col("last"))
    return exact.groupBy(*by).agg(
        F.floor(
            _interpolate(
                F.max(F.when(covers("lo_at"), F.col("us"))),
                F.max(F.when(covers("hi_at"), F.col("us"))),
                F.max("weight"),
            )
        ).alias("cut_us"),
        F.max("first_us").alias("first_us"),
        F.max("last_us").alias("last_us"),
    )


def chronological_events(events: DataFrame, fraction: float = 0.7, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Event split at the time quantile: at or before the cut is train.

    If one part would be empty (all times equal), the first ``fraction`` of the rows by (time, id) is train.
    """
    cuts = cut(time_quantile(events, fraction, by))
    flat = (F.col("last_us") <= F.col("cut_us")) | (F.col("first_us") > F.col("cut_us"))
    n_flat = cuts.filter(flat).count()
    marked = attach_groups(events, cuts, by)
    late = tp.micros(F.col("timestamp")) > F.col("cut_us")
    out = marked.filter(~flat).withColumn("part", F.when(late, "test").otherwise("train"))
    drop = ["first_us", "last_us"]
    if not n_flat:
        return out.drop(*drop)
    order = ranked(marked.filter(flat), by, [F.col("timestamp"), F.col("event_id")])
    n_train = F.greatest(F.lit(1), F.floor(F.col("group_size") * F.lit(fraction)))
    rest = order.withColumn("part", F.when(F.col("rank") <= n_train, "train").otherwise("test"))
    return out.drop(*drop).unionByName(rest.drop(*drop, "rank", "group_size"))


def day_quantile(user_days: DataFrame, fraction: float = 0.7, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Interpolated quantile of ``day`` (days since 1970) per group, over a per-day count table."""
    per_day = user_days.groupBy(*by, F.unix_date("day").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return per_day.groupBy(*by).agg(F.percentile("d", fraction, F.col("n")).alias("cut_day"))


def chronological_user_days(user_days: DataFrame, fraction: float = 0.7,
                            by: Sequence[str] = ("dataset",)) -> DataFrame:
    cuts = day_quantile(user_days, fraction, by)
    late = F.unix_date("day") > F.col("cut_day")
    return attach_groups(user_days, cuts, by).withColumn("part", F.when(late, "test").otherwise("train"))


def median_positive_day(user_days: DataFrame) -> DataFrame:
    """Median of the distinct days that hold a positive, per domain."""
    days = user_days.filter("label = 1").select("dataset", F.unix_date("day").alias("d")).distinct()
    return days.groupBy("dataset").agg(F.percentile("d", 0.5).alias("cut_day"))


def active_window_quantile(user_days: DataFrame, fraction: float = 0.7) -> DataFrame:
    """The chronological cut taken only over user-days between the first and the last positive day."""
    span = user_days.filter("label = 1").groupBy("dataset").agg(
        F.min("day").alias("first_day"), F.max("day").alias("last_day")
    )
    inside = attach_groups(user_days, span, ["dataset"]).filter(F.col("day").between(F.col("first_day"), F.col("last_day")))
    return day_quantile(inside, fraction).join(span, "dataset")


def validation_tail(train: DataFrame, fraction: float = 0.15) -> DataFrame:
    """The last ``fraction`` of the rows by (day, user) becomes ``val``; at least 1 row, and 1 left to train on."""
    out = ranked(train, ["dataset"], [F.col("day"), F.col("user")])
    n = F.col("group_size")
    n_val = F.least(F.greatest(F.bround(n * F.lit(fraction)).cast("long"), F.lit(1)), n - 1)
    part = F.when(F.col("rank") > n - n_val, "val").otherwise("train")
    return out.withColumn("part", part).drop("rank", "group_size")


def user_parts(rows: DataFrame, fraction: float = 0.7, seeds: Sequence[int] = (0,), names=("train", "test"),
               keep_single: str | None = None) -> DataFrame:
    """Part of every (dataset, user) for each seed, drawn separately for users with and without positives.

    The first part takes ``round(n * fraction)`` users, and at least one user stays on each side when there
    are two. ``keep_single`` names the part of the only user of a class (default: by rounding).
    """
    users = rows.groupBy("dataset", "user").agg(F.max("label").alias("positive_user"))
    users = users.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    users = users.withColumn("_digest", digest(F.col("seed"), F.col("user")))
    out = ranked(users, ["dataset", "seed", "positive_user"], [F.col("_digest"), F.col("user")])
    n = F.col("group_size")
    want = F.bround(n * F.lit(fraction)).cast("long")
    take = F.when(n >= 2, F.least(F.greatest(want, F.lit(1)), n - 1))
    take = take.otherwise(want if keep_single is None else F.lit(int(keep_single == names[0])))
    return out.select(
        "dataset", "user", "seed", "positive_user",
        F.when(F.col("rank") <= take, names[0]).otherwise(names[1]).alias("part"),
    )


def user_disjoint(rows: DataFrame, fraction: float = 0.7, seeds: Sequence[int] = (0,)) -> DataFrame:
    """Every row once per seed with the part of its user; no user is on both sides.

    A domain whose test part would be empty gives it one user.
    """
    parts = user_parts(rows, fraction, seeds)
    lonely = parts.groupBy("dataset", "seed").agg(
        F.count_if(F.col("part") == "test").alias("_n_test"),
        F.min_by("user", F.struct(digest(F.col("seed"), F.col("user")), "user")).alias("_first"),
    )
    moved = (F.col("_n_test") == 0) & (F.col("user") == F.col("_first"))
    parts = parts.join(lonely, ["dataset", "seed"]).withColumn(
        "part", F.when(moved, "test").otherwise(F.col("part"))
    )
    return rows.join(parts.select("dataset", "user", "seed", "part"), ["dataset", "user"])


def validation_users(rows: DataFrame, fraction: float = 0.15, seed: int = 0) -> DataFrame:
    """Validation part by user, per class; the only user of a class stays in train."""
    parts = user_parts(rows, fraction, (seed,), names=("val", "train"), keep_single="train")
    return rows.join(parts.select("dataset", "user", "part"), ["dataset", "user"])


def split_report(rows: DataFrame, time: str = "timestamp", by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Rows, positives, time range and users of both parts, and the users found in both."""
    def side(name: str) -> list[Column]:
        here = F.col("part") == name
        return [
            F.count_if(here).alias(f"n_{name}"),
            F.sum(F.when(here, F.col("label")).otherwise(0)).alias(f"pos_{name}"),
            F.min(F.when(here, F.col(time))).alias(f"first_{name}"),
            F.max(F.when(here, F.col(time))).alias(f"last_{name}"),
        ]

    per_user = rows.groupBy(*by, "user").agg(*side("train"), *side("test"))
    in_train, in_test = F.col("n_train") > 0, F.col("n_test") > 0
    totals = []
    for name in ("train", "test"):
        totals += [
            F.sum(f"n_{name}").alias(f"n_{name}"),
            F.sum(f"pos_{name}").alias(f"pos_{name}"),
            F.min(f"first_{name}").alias(f"first_{name}"),
            F.max(f"last_{name}").alias(f"last_{name}"),
        ]
    return per_user.groupBy(*by).agg(
        *totals,
        F.count_if(in_train).alias("users_train"),
        F.count_if(in_test).alias("users_test"),
        F.count_if(in_train & in_test).alias("users_both"),
    )
