"""Per-user and per-user-day sequences, action transitions and decayed activity profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daymark.operators.ordered import attach_groups
from daymark.schema import ACTIONS, BASE_COLUMNS, COUNT_COLUMNS, USER_DAY_KEY, action_id

START = "<start>"


def context_windows(features: DataFrame, columns: Sequence[str] = BASE_COLUMNS, length: int = 8) -> DataFrame:
    """``context``: the vectors of the current and up to ``length - 1`` earlier days, zero-padded on the left."""
    vector = F.array(*[F.col(c).cast("double") for c in columns])
    w = Window.partitionBy("dataset", "user").orderBy("day").rowsBetween(-(length - 1), 0)
    seen = F.collect_list(vector).over(w)
    zero = F.array_repeat(F.lit(0.0), len(columns))
    return features.withColumn("_seen", seen).withColumn(
        "context", F.concat(F.array_repeat(zero, F.lit(length) - F.size("_seen")), F.col("_seen"))
    ).withColumn("n_context", F.size("_seen")).drop("_seen")


def day_sequences(features: DataFrame, columns: Sequence[str] = BASE_COLUMNS, last: int = 64) -> DataFrame:
    """Per user: the vectors of the last ``last`` days in day order."""
    newest = Window.partitionBy("dataset", "user").orderBy(F.desc("day"))
    recent = features.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= last)
    item = F.struct("day", F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))
    return recent.groupBy("dataset", "user").agg(F.array_sort(F.collect_list(item)).alias("days"))


def token_sequences(events: DataFrame, last: int = 64, pad: int = len(ACTIONS)) -> DataFrame:
    """Per user-day: the last ``last`` action ids in time order, right-padded, with a padding mask.

    The row-number filter is applied inside each task before the shuffle, so a user-day with very many
    events sends at most ``last`` rows per task.
    """
    ids = events.select(*USER_DAY_KEY, "timestamp", "event_id", action_id(F.col("action")).cast("int").alias("a"))
    newest = Window.partitionBy(*USER_DAY_KEY).orderBy(F.desc("timestamp"), F.desc("event_id"), F.desc("a"))
    recent = ids.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= last)
    tokens = F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("o"), "a"))), lambda s: s["a"]
    )
    out = recent.groupBy(*USER_DAY_KEY).agg(tokens.alias("seen")).withColumn("n_tokens", F.size("seen"))
    return out.select(
        *USER_DAY_KEY, "n_tokens",
        F.concat("seen", F.array_repeat(F.lit(pad), F.lit(last) - F.col("n_tokens"))).alias("tokens"),
        F.transform(F.sequence(F.lit(1), F.lit(last)), lambda i: i > F.col("n_tokens")).alias("mask"),
    )


def transitions(events: DataFrame) -> DataFrame:
    """Counts of consecutive action pairs per user-day; the first action follows ``<start>``.

    Pairs inside one clock minute come from a window over that minute; pairs across minutes come from the
    first and last action of each minute. So even a user-day with most of the events is spread over its minutes.
    """
    place = F.struct("timestamp", "event_id", "action")
    rows = events.select(
        *USER_DAY_KEY, "timestamp", "event_id", "action",
        (F.hour("timestamp") * 60 + F.minute("timestamp")).alias("minute"),
    )
    inside = Window.partitionBy(*USER_DAY_KEY, "minute").orderBy("timestamp", "event_id", "action")
    pairs = rows.withColumn("prev", F.lag("action").over(inside)).filter("prev IS NOT NULL")
    pairs = pairs.groupBy(*USER_DAY_KEY, "prev", "action").agg(F.count(F.lit(1)).alias("n"))
    ends = rows.groupBy(*USER_DAY_KEY, "minute").agg(
        F.min_by("action", place).alias("action"), F.max_by("action", place).alias("last")
    )
    across = Window.partitionBy(*USER_DAY_KEY).orderBy("minute")
    joints = ends.select(
        *USER_DAY_KEY, F.coalesce(F.lag("last").over(across), F.lit(START)).alias("prev"), "action",
        F.lit(1).cast("long").alias("n"),
    )
    return pairs.unionByName(joints).groupBy(*USER_DAY_KEY, "prev", "action").agg(F.sum("n").alias("n"))


def transition_model(train: DataFrame, smoothing: float = 1.0) -> DataFrame:
    """Log probability of every (prev, action), smoothed. A fixed number of rows: 17 x 16."""
    counts = train.groupBy("prev", "action").agg(F.sum("n").alias("n"))
    names = F.explode(F.array(*[F.lit(p) for p in [START, *ACTIONS]]))
    grid = train.sparkSession.range(1).select(names.alias("prev")).select(
        "prev", F.explode(F.array(*[F.lit(a) for a in ACTIONS])).alias("action")
    )
    full = grid.join(F.broadcast(counts), ["prev", "action"], "left").na.fill(0, ["n"])
    total = F.sum("n").over(Window.partitionBy("prev"))
    return full.select(
        "prev", "action",
        F.log((F.col("n") + smoothing) / (total + smoothing * len(ACTIONS))).alias("log_p"),
    )


def sequence_scores(pairs: DataFrame, model: DataFrame) -> DataFrame:
    """Per user-day: mean and largest surprise of its actions. The model has a fixed size, so it is broadcast.

    A transition that the model lacks is as surprising as its most surprising one.
    """
    floor = model.agg(F.min("log_p")).first()[0] or 0.0
    scored = pairs.join(F.broadcast(model), ["prev", "action"], "left").fillna(floor, ["log_p"])
    return scored.groupBy(*USER_DAY_KEY).agg(
        (-F.sum(F.col("n") * F.col("log_p")) / F.sum("n")).alias("mean_surprise"),
        F.max(-F.col("log_p")).alias("max_surprise"),
        F.sum("n").alias("n_actions"),
    )


# ---- memory ---------------------------------------------------------------------------------------


def decayed_profile(daily: DataFrame, keys: Sequence[str], columns: Sequence[str], time_constant: float = 7.0,
                    prefix: str = "mem_") -> DataFrame:
    """Exponentially decayed sums of ``columns`` over strictly earlier days of each key.

    The weight is ``exp(-age / time_constant)`` with the age in days: a running sum of counts grown by their day's
    weight, shrunk back at the reading day. Weights are relative to the start of a block of 100 time constants; the total of
    the block before is added, and what is older weighs less than e^-100.
    """
    rate, span = 1.0 / time_constant, round(100 * time_constant)
    group = Window.partitionBy(*keys)
    age = F.datediff(F.col("day"), F.min("day").over(group))
    aged = daily.withColumn("_age", age).withColumn("_block", F.floor(F.col("_age") / span))
    block = Window.partitionBy(*keys, "_block")
    earlier = block.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    grow = F.exp((F.col("_age") - F.col("_block") * span) * rate)
    here = aged.withColumns({f"_in_{c}": F.coalesce(F.sum(F.col(c) * grow).over(earlier) / grow, F.lit(0.0)) for c in columns})
    here = here.withColumns({f"_all_{c}": F.sum(F.col(c) * grow).over(block) for c in columns})
    # The last row before a block carries the total of the block it belongs to.
    before = group.orderBy("day")
    here = here.withColumns({f"_lag_{c}": F.lag(f"_all_{c}").over(before) for c in columns} | {"_lag_block": F.lag("_block").over(before)})
    first = block.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    shrink = F.exp(-(F.col("_age") - F.first("_lag_block").over(first) * span) * rate)
    out = here.withColumns({f"{prefix}{c}": F.col(f"_in_{c}") + F.coalesce(F.first(f"_lag_{c}").over(first) * shrink, F.lit(0.0)) for c in columns})
    return out.drop("_age", "_block", "_lag_block", *[f"_{k}_{c}" for k in ("in", "all", "lag") for c in columns])


def memory_features(events: DataFrame, features: DataFrame, time_constant: float = 7.0) -> DataFrame:
    """User-day features with the decayed action profile of the user and of the hosts it touched.

    Both sides of the last join are together by user; planned under ``session.co_partitioned``, it moves neither.
    """
    user = decayed_profile(features, ["dataset", "user"], COUNT_COLUMNS, time_constant, "mem_")
    host_day = events.groupBy("dataset", F.col("dst_host").alias("host"), "day").agg(
        *[F.count_if(F.col("action") == a).alias(f"cnt_{a}") for a in ACTIONS]
    )
    host = decayed_profile(host_day, ["dataset", "host"], COUNT_COLUMNS, time_constant, "host_")
    profile = host.select("dataset", "host", "day", *[f"host_{c}" for c in COUNT_COLUMNS])
    touched = events.select(*USER_DAY_KEY, F.col("dst_host").alias("host")).distinct()
    # Pairs are moved before they carry their profile. A small profile is broadcast, and then nothing is moved again before the means.
    means = attach_groups(touched.repartition("dataset", "user"), profile, ["dataset", "host", "day"]).groupBy(*USER_DAY_KEY).agg(
        *[F.avg(f"host_{c}").alias(f"host_{c}") for c in COUNT_COLUMNS]
    )
    return user.join(means, USER_DAY_KEY, "left").na.fill(0.0, [f"host_{c}" for c in COUNT_COLUMNS])
