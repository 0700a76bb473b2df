"""The experiment grid with model-free scores: every source, target, protocol and seed in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daymark.operators.features import scale_statistics
from daymark.operators.metrics import pr_roc
from daymark.operators.results import CELL
from daymark.operators.scores import deviation_scores, scores_on
from daymark.operators.splits import chronological_user_days, user_parts
from daymark.schema import BASE_COLUMNS
from daymark.session import fixed


def grid_predictions(user_days: DataFrame, domains: Sequence[str], seeds: Sequence[int]) -> DataFrame:
    """Prediction rows of all cells.

    A training set is the train part of a source under a protocol and seed. Other domains are scored whole
    with the user-disjoint training set; the source itself is scored on the held-out part of each protocol.
    """
    rows = user_days.select("dataset", "user", "day", "label", *BASE_COLUMNS)
    seed_list = F.explode(F.array(*[F.lit(s) for s in seeds]))
    parts = user_parts(rows, 0.7, seeds).select("dataset", "user", "seed", "part")
    by_user = rows.join(parts, ["dataset", "user"]).withColumn("trained", F.lit("user_disjoint"))
    by_time = (
        chronological_user_days(rows).drop("cut_day").withColumn("trained", F.lit("temporal")).withColumn("seed", seed_list)
    )
    both = by_user.unionByName(by_time)
    train = both.filter("part = 'train'").withColumnRenamed("dataset", "source")
    own = (
        both.filter("part = 'test'")
        .withColumn("source", F.col("dataset"))
        .withColumn("protocol", F.col("trained"))
        .drop("part")
    )
    others = (
        rows.withColumn("source", F.explode(F.array(*[F.lit(d) for d in domains])))
        .filter("source <> dataset")
        .withColumn("seed", seed_list)
        .withColumn("trained", F.lit("user_disjoint"))
        .withColumn("protocol", F.lit("full_source"))
    )
    targets = own.unionByName(others).withColumnRenamed("dataset", "target")
    return deviation_scores(targets, train, ["source", "trained", "seed"]).select(*CELL, "user", "day", "score", "label")


def with_parts(rows: DataFrame, seeds: Sequence[int]) -> DataFrame:
    """Each row once, with the seeds under which its user is held out (``tested``) or trained on (``learned``), null for a row without a user, and
    whether it lies after the cut of its domain (``late``)."""
    parts = user_parts(rows.select("dataset", "user", "label"), 0.7, seeds)
    of = lambda part: F.array_sort(F.collect_list(F.when(F.col("part") == part, F.col("seed"))))
    users = parts.groupBy("dataset", "user").agg(of("train").alias("learned"), of("test").alias("tested"))  # a user's seeds
    timed = chronological_user_days(rows).drop("cut_day")
    return timed.join(users, ["dataset", "user"], "left").withColumn("late", F.col("part") == "test").drop("part")


def folded(rows: DataFrame, keys: Sequence[str], times: Column) -> DataFrame:
    return rows.groupBy(*keys).agg(times.alias("times"))


def grid_results(user_days: DataFrame, domains: Sequence[str], seeds: Sequence[int]) -> DataFrame:
    """Metrics of all cells of ``grid_predictions``. A score depends on the features alone, so rows with equal features, label and parts are counted
    before they meet the training sets, and a row is held once and not once per seed and source."""
    rows = fixed(with_parts(user_days.select("dataset", "user", "day", "label", *BASE_COLUMNS), seeds))
    every = F.array(*[F.lit(s) for s in seeds])
    by_user = rows.filter("learned is not null").withColumn("seed", F.explode("learned")).withColumn("trained", F.lit("user_disjoint"))
    set_key = ["source", "trained", "seed"]
    of_users = scale_statistics(by_user.withColumnRenamed("dataset", "source"), BASE_COLUMNS, set_key)
    early = rows.filter(~F.col("late")).withColumnRenamed("dataset", "source").withColumn("trained", F.lit("temporal"))
    of_time = scale_statistics(early, BASE_COLUMNS, ["source", "trained"]).withColumn("seed", F.explode(every))  # seeds share the cut
    stats = fixed(of_users.unionByName(of_time))
    kinds = fixed(folded(rows, ["dataset", "label", *BASE_COLUMNS, "tested", "late"], F.count(F.lit(1))))
    whole = folded(kinds, ["dataset", "label", *BASE_COLUMNS], F.sum("times"))
    cell = lambda protocol: [F.col("dataset").alias("target"), F.lit(protocol).alias("protocol"), "seed", "label", *BASE_COLUMNS, "times"]
    held = kinds.filter("tested is not null").withColumn("seed", F.explode("tested"))
    after = kinds.filter("late").withColumn("seed", F.explode(every))
    own = [d.select(F.col("dataset").alias("source"), F.lit(p).alias("trained"), *cell(p)) for d, p in ((held, "user_disjoint"), (after, "temporal"))]
    others = whole.withColumn("source", F.explode(F.array(*[F.lit(d) for d in domains]))).filter("source <> dataset").withColumn("seed", F.explode(every))
    targets = own[0].unionByName(own[1]).unionByName(others.select("source", F.lit("user_disjoint").alias("trained"), *cell("full_source")))
    return pr_roc(scores_on(targets, stats, set_key), CELL, "times")
