"""Sampling by hash draws, and the audit that a sampler did not look at labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daymark.functions.hashing import digest, draw
from daymark.operators.labels import flag_intervals, flag_roster
from daymark.operators.ordered import attach_groups, ranked
from daymark.operators.selection import first_of_groups, first_rows, text_prefixes, time_prefixes

SAMPLE_SEED = 7
ROW_COLUMNS = ["timestamp", "user", "src_host", "dst_host", "action", "object", "label"]


def keep(fraction: float, seed: int = SAMPLE_SEED, key: str = "event_id") -> Column:
    return draw(seed, F.col(key)) < fraction


def uniform_sample(events: DataFrame, channel: Column, fraction: float, seed: int = SAMPLE_SEED) -> DataFrame:
    """Rows of ``channel`` kept with one rate for every user; other rows kept whole."""
    return events.filter(~channel | keep(fraction, seed))


def roster_sample(events: DataFrame, roster: DataFrame, channel: Column, fraction: float,
                  seed: int = SAMPLE_SEED) -> DataFrame:
    """Superseded rule, kept as the other side of the audit: roster users are never thinned."""
    return flag_roster(events, roster).filter(~channel | F.col("on_roster") | keep(fraction, seed)).drop("on_roster")


def interval_sample(events: DataFrame, intervals: DataFrame, fraction: float, host: str = "src_host",
                    seed: int = SAMPLE_SEED) -> DataFrame:
    """All rows inside a label interval plus a fraction of the rest; ``in_interval`` is kept."""
    return flag_intervals(events, intervals, host).filter(F.col("in_interval") | keep(fraction, seed))


def head_sample(events: DataFrame, n: int, narrow: int | None = None) -> DataFrame:
    """The first ``n`` events in time, then by id and domain, found by counting: no task sorts or holds them."""
    micros = F.unix_micros(F.col("timestamp").cast("timestamp"))
    span = events.agg(F.min(micros).alias("low"), F.max(F.length("event_id")).alias("longest")).first()
    if span["low"] is None:
        return events.limit(0)
    times = time_prefixes(micros, span["low"])
    ids = text_prefixes(F.col("event_id"), span["longest"] or 1)  # inside one time
    return first_rows(events.filter("timestamp IS NOT NULL"), n, [*times, *ids], [F.col("timestamp"), F.col("event_id"), F.col("dataset")], narrow)


def multiset_difference(a: DataFrame, b: DataFrame, columns: Sequence[str] = ROW_COLUMNS,
                        by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Rows only in ``a`` and only in ``b``, counting copies, per group.

    Both sides are folded to one row per fingerprint before anything meets, so repeated rows do not
    weigh on the shuffle.
    """
    mark = [F.xxhash64(*columns).alias("fp1"), F.hash(*columns).alias("fp2")]
    rows = a.select(*by, *mark, F.lit(1).alias("side")).unionByName(b.select(*by, *mark, F.lit(-1).alias("side")))
    net = rows.groupBy(*by, "fp1", "fp2").agg(F.sum("side").alias("net"), F.count(F.lit(1)).alias("n"))
    return net.groupBy(*by).agg(
        F.sum(F.greatest("net", F.lit(0))).alias("only_a"),
        F.sum(F.greatest(-F.col("net"), F.lit(0))).alias("only_b"),
        F.sum("n").alias("n_both_sides"),
    )


def sampling_audit(strict: DataFrame, loose: DataFrame, channel: Column, fraction: float) -> DataFrame:
    """Per domain: only roster rows of the sampled channel may differ, the strict ones must be a subset,
    and their keep rate must agree with the sampling rate.

    Both inputs carry ``on_roster``. Everything comes from one pass over the tagged union.
    """
    touched = F.col("on_roster") & channel
    mark = [F.xxhash64(*ROW_COLUMNS).alias("fp1"), F.hash(*ROW_COLUMNS).alias("fp2")]

    def side(df: DataFrame, s: int, l: int) -> DataFrame:
        return df.select("dataset", touched.alias("touched"), *mark, F.lit(s).alias("s"), F.lit(l).alias("l"))

    rows = side(strict, 1, 0).unionByName(side(loose, 0, 1))
    copies = rows.groupBy("dataset", "touched", "fp1", "fp2").agg(F.sum("s").alias("s"), F.sum("l").alias("l"))
    strict_extra = F.greatest(F.col("s") - F.col("l"), F.lit(0))
    loose_extra = F.greatest(F.col("l") - F.col("s"), F.lit(0))

    def total(value: Column, where: Column) -> Column:
        return F.sum(F.when(where, value).otherwise(0))

    t, u = F.col("touched"), ~F.col("touched")
    out = copies.groupBy("dataset").agg(
        F.sum("s").alias("strict_rows"),
        F.sum("l").alias("loose_rows"),
        total(strict_extra, u).alias("other_only_in_strict"),
        total(loose_extra, u).alias("other_only_in_loose"),
        total(F.col("s"), t).alias("roster_rows_strict"),
        total(F.col("l"), t).alias("roster_rows_loose"),
        total(strict_extra, t).alias("roster_only_in_strict"),
    )
    n, k = F.col("roster_rows_loose"), F.col("roster_rows_strict")
    rate = F.when(n > 0, k / n)
    z = F.when(n > 0, (k / n - F.lit(fraction)) / F.sqrt(F.lit(fraction * (1 - fraction)) / n))
    return (
        out.withColumn("roster_keep_rate", rate)
        .withColumn("roster_keep_z", z)
        .withColumn(
            "passed",
            (F.col("other_only_in_strict") == 0)
            & (F.col("other_only_in_loose") == 0)
            & (F.col("roster_only_in_strict") == 0)
            & F.coalesce(F.abs(z) < 5, F.lit(False)),
        )
    )


def keep_rates(events: DataFrame, channel: Column, fraction: float, group: str = "on_roster",
               seed: int = SAMPLE_SEED) -> DataFrame:
    """Scanned and kept channel rows, keep rate and its z score, per domain and user group."""
    n, k = F.count(F.lit(1)), F.count_if(keep(fraction, seed))
    out = events.filter(channel).groupBy("dataset", group).agg(
        n.alias("scanned"), k.alias("kept"), F.count_distinct("user").alias("n_users")
    )
    rate = F.col("kept") / F.col("scanned")
    z = (rate - F.lit(fraction)) / F.sqrt(F.lit(fraction * (1 - fraction)) / F.col("scanned"))
    return out.withColumn("keep_rate", rate).withColumn("z", z).withColumn("passed", F.abs(z) < 5)


def balanced_sample(rows: DataFrame, key: Column, seed: int, cap: int | None = None,
                    by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Every group cut to the size of the smallest one (and to ``cap``), in hash order."""
    order = rows.withColumn("_digest", digest(seed, key))
    out = ranked(order, by, [F.col("_digest"), key])
    sizes = out.filter("rank = 1").agg(F.min("group_size").alias("k"))
    k = sizes.first()["k"] or 0
    return out.filter(F.col("rank") <= (k if cap is None else min(k, cap))).drop("_digest")


def cap_keeping_positives(rows: DataFrame, key: Column, cap: int, seed: int,
                          by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Training rows cut to ``cap``: up to max(200, cap // 20) positives, the rest negatives; small groups whole."""
    sizes = rows.groupBy(*by).agg(F.count_if(F.col("label") == 1).alias("_pos"), F.count(F.lit(1)).alias("_n"))
    n_pos = F.least(F.col("_pos"), F.lit(max(200, cap // 20)))
    share = F.when(F.col("label") == 1, n_pos).otherwise(F.lit(cap) - n_pos)
    labels = sizes.withColumn("label", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("label", F.col("label").cast(rows.schema["label"].dataType))
    allowed = labels.select(*by, "label", F.when(F.col("_n") <= cap, F.col("_n")).otherwise(share).cast("long").alias("allowed"))
    return first_of_groups(rows, [*by, "label"], digest(seed, key), key, allowed)


def negative_rows(train: DataFrame, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Negative training rows; all rows of a group that has none."""
    has = train.groupBy(*by).agg(F.max(F.when(F.col("label") == 0, 1).otherwise(0)).alias("_has_neg"))
    return attach_groups(train, has, by).filter((F.col("label") == 0) | (F.col("_has_neg") == 0)).drop("_has_neg")


def negative_users(rows: DataFrame, at_least: int = 8) -> DataFrame:
    """Rows of users without any positive day; all rows of a domain with fewer than ``at_least`` of them."""
    users = rows.groupBy("dataset", "user").agg(F.max("label").alias("_any"))
    enough = users.groupBy("dataset").agg((F.count_if(F.col("_any") == 0) >= at_least).alias("_enough"))
    joined = attach_groups(rows.join(users, ["dataset", "user"]), enough, ["dataset"])
    return joined.filter((F.col("_any") == 0) | ~F.col("_enough")).drop("_any", "_enough")
