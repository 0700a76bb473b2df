"""User-day features: counts, breadth, time of day, and deviation from the user's own earlier days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daymark.functions import timeparts as tp
from daymark.operators.ordered import attach_groups
from daymark.schema import (
    ACTIONS, BASE_COLUMNS, COUNT_COLUMNS, DEV_COLUMNS, FEATURE_COLUMNS, USER_DAY_KEY,
)

PARTIAL_COLUMNS = COUNT_COLUMNS + ["n_events", "n_offhours", "hour_sum", "hour_sumsq"]


def sample_std(n: Column, total: Column, squares: Column) -> Column:
    """Sample standard deviation from sums; 0 for a single value."""
    n, total, squares = (c.cast("double") for c in (n, total, squares))
    return F.when(n > 1, F.sqrt(F.greatest((squares - total * total / n) / (n - 1), F.lit(0.0)))).otherwise(0.0)


def _finish(sums: DataFrame) -> DataFrame:
    n = F.col("n_events")
    return (
        sums.withColumn("frac_offhours", F.col("n_offhours") / n)
        .withColumn("hour_mean", F.col("hour_sum") / n)
        .withColumn("hour_std", sample_std(n, F.col("hour_sum"), F.col("hour_sumsq")))
        .drop("n_offhours", "hour_sum", "hour_sumsq")
    )


def partial_aggregates(events: DataFrame, keys: Sequence[str] = USER_DAY_KEY) -> DataFrame:
    """Mergeable user-day sums."""
    hour = F.hour("timestamp")
    return events.groupBy(*keys).agg(
        *[F.count_if(F.col("action") == a).alias(f"cnt_{a}") for a in ACTIONS],
        F.count(F.lit(1)).alias("n_events"),
        F.sum(tp.off_hours(hour)).alias("n_offhours"),
        F.sum(hour).alias("hour_sum"),
        F.sum(hour * hour).alias("hour_sumsq"),
    )


def host_pairs(events: DataFrame, keys: Sequence[str] = USER_DAY_KEY) -> DataFrame:
    """Distinct (user-day, host) rows: the mergeable form of the distinct host count."""
    return events.select(*keys, "dst_host").distinct()


def merge_partials(partials: DataFrame, hosts: DataFrame, keys: Sequence[str] = USER_DAY_KEY) -> DataFrame:
    """Fold partial sums and host pairs of any number of batches into base features."""
    sums = partials.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in PARTIAL_COLUMNS])
    breadth = hosts.select(*keys, "dst_host").distinct().groupBy(*keys).agg(
        F.count("dst_host").alias("n_distinct_hosts")
    )
    joined = sums.join(breadth, list(keys), "left").na.fill(0, ["n_distinct_hosts"])
    return _finish(joined).select(*keys, *BASE_COLUMNS)


def base_features(events: DataFrame, keys: Sequence[str] = USER_DAY_KEY) -> DataFrame:
    """One row per user-day with the 21 base features, in a single aggregation."""
    hour = F.hour("timestamp")
    sums = events.groupBy(*keys).agg(
        *[F.count_if(F.col("action") == a).alias(f"cnt_{a}") for a in ACTIONS],
        F.count(F.lit(1)).alias("n_events"),
        F.count_distinct("dst_host").alias("n_distinct_hosts"),
        F.sum(tp.off_hours(hour)).alias("n_offhours"),
        F.sum(hour).alias("hour_sum"),
        F.sum(hour * hour).alias("hour_sumsq"),
    )
    return _finish(sums).select(*keys, *BASE_COLUMNS)


def label_user_days(features: DataFrame, keys: DataFrame) -> DataFrame:
    """Label 1 where the user-day is in the key table. Runs after aggregation, on the small side."""
    flags = keys.select(*USER_DAY_KEY).distinct().withColumn("label", F.lit(1))
    return features.join(flags, USER_DAY_KEY, "left").na.fill(0, ["label"])


def earlier_days(keys: Sequence[str] = ("dataset", "user")):
    return Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)


def add_deviation(features: DataFrame, columns: Sequence[str] = BASE_COLUMNS) -> DataFrame:
    """``dev_x``: distance of x from the mean of the user's earlier days, in their population std.

    A user has at most one row per day, so a window group is bounded by the calendar. All columns share
    one window, hence one shuffle and one sort.
    """
    w = earlier_days()
    out = features
    rounded = {c: F.round(F.col(c), 9) if c in BASE_COLUMNS[-3:] else F.col(c) for c in columns}
    return out.select(
        "*",
        *[
            F.coalesce((x - F.avg(x).over(w)) / (F.stddev_pop(x).over(w) + F.lit(1e-6)), F.lit(0.0)).alias(f"dev_{c}")
            for c, x in rounded.items()
        ],
    )


def user_day_features(events: DataFrame, keys: DataFrame | None = None, deviation: bool = True) -> DataFrame:
    """Base features, label and, if wanted, deviation features."""
    out = base_features(events)
    out = label_user_days(out, keys) if keys is not None else out.withColumn("label", F.lit(0))
    return add_deviation(out) if deviation else out


def cold_start_report(features: DataFrame) -> DataFrame:
    """Per domain: users' first days, and feature cells set to 0 for lack of history."""
    first = F.row_number().over(Window.partitionBy("dataset", "user").orderBy("day")) == 1
    return (
        features.select("dataset", first.alias("first"))
        .groupBy("dataset")
        .agg(
            F.count(F.lit(1)).alias("n_user_days"),
            F.count_if("first").alias("n_first_days"),
            (F.count_if("first") * len(BASE_COLUMNS)).alias("n_cells_filled"),
        )
    )


def active_columns(features: DataFrame) -> list[str]:
    """All 42 feature columns if any deviation column is present, else the 21 base columns."""
    return FEATURE_COLUMNS if any(c in DEV_COLUMNS for c in features.columns) else BASE_COLUMNS


def align_features(features: DataFrame, keys: Sequence[str] = USER_DAY_KEY) -> DataFrame:
    """Fixed column order of a cached feature table; a missing column is an error."""
    wanted = [*keys, "label", *FEATURE_COLUMNS]
    missing = [c for c in wanted if c not in features.columns]
    if missing:
        raise ValueError(f"missing feature columns: {missing}")
    return features.select(*wanted)


def restrict_to(features: DataFrame, pairs: DataFrame) -> DataFrame:
    """Full-stream feature rows of the user-days present in a split; history stays causal."""
    return features.join(pairs.select(*USER_DAY_KEY).distinct(), USER_DAY_KEY, "left_semi")


# ---- scaling ----------------------------------------------------------------------------------


def scale_statistics(train: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean and population std of each column over the training rows; std 0 becomes 1."""
    aggs = []
    for c in columns:
        aggs.append(F.avg(c).alias(f"mean_{c}"))
        aggs.append(F.stddev_pop(c).alias(f"std_{c}"))
    stats = train.groupBy(*by).agg(*aggs)
    return stats.select(
        *by,
        *[f"mean_{c}" for c in columns],
        *[F.when(F.col(f"std_{c}") > 1e-12, F.col(f"std_{c}")).otherwise(1.0).alias(f"std_{c}") for c in columns],
    )


def clip(x: Column, bound: float = 8.0) -> Column:
    return F.greatest(F.least(x, F.lit(bound)), F.lit(-bound))


def standardise(
    rows: DataFrame,
    stats: DataFrame,
    columns: Sequence[str] = BASE_COLUMNS,
    by: Sequence[str] = (),
    bound: float | None = 8.0,
) -> DataFrame:
    """Scale ``columns`` with training statistics and clip; deviation columns are clipped only.

    Without ``by`` the statistics are a single row, used as literals; with it, one row per group.
    """
    if by:
        joined = attach_groups(rows, stats, by)
        stat = F.col
    else:
        joined, row = rows, stats.first()
        stat = lambda name: F.lit(float(row[name]))
    limit = (lambda x: clip(x, bound)) if bound is not None else (lambda x: x)
    keep = [c for c in rows.columns if c not in columns and c not in DEV_COLUMNS]
    scaled = [limit((F.col(c) - stat(f"mean_{c}")) / stat(f"std_{c}")).alias(c) for c in columns]
    dev = [(limit(F.col(c)) if c not in columns else F.col(c)).alias(c) for c in DEV_COLUMNS
           if c in rows.columns and c not in columns]
    return joined.select(*keep, *scaled, *dev)
