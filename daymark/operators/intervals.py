"""Seed bootstrap intervals, paired differences and the words used for them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daymark.functions.hashing import draw


def seed_bootstrap(results: DataFrame, by: Sequence[str], value: str, prefix: str, n_boot: int = 5000,
                   alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """Mean over seeds with a percentile interval of resampled means.

    A cell holds one value per seed, so its values fit an array. Draw i of replicate b picks the value at
    ``floor(u(seed:b:i) * n)`` in seed order. One value gives a point interval, none gives nulls.
    """
    listed = results.groupBy(*by).agg(
        F.array_sort(
            F.collect_list(F.when(F.col(value).isNotNull() & ~F.isnan(value), F.struct("seed", F.col(value).alias("v"))))
        ).alias("pairs")
    )
    listed = listed.select(*by, F.transform("pairs", lambda p: p["v"]).alias("vals"))
    n = F.size("vals")
    spread = listed.filter(n > 0).select(
        *by, "vals", n.alias("n"), F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("b")
    )
    pick = lambda i: F.get("vals", F.floor(draw(seed, F.col("b"), i) * F.col("n")).cast("int"))
    total = F.aggregate(F.sequence(F.lit(0), F.col("n") - 1), F.lit(0.0), lambda acc, i: acc + pick(i))
    means = spread.select(*by, (total / F.col("n")).alias("m"))
    ends = means.groupBy(*by).agg(
        F.percentile("m", alpha / 2).alias(f"{prefix}_lo"), F.percentile("m", 1 - alpha / 2).alias(f"{prefix}_hi")
    )
    mean = F.aggregate("vals", F.lit(0.0), lambda acc, v: acc + v) / F.nullif(n, F.lit(0))
    points = listed.select(*by, mean.alias(f"{prefix}_mean"), n.cast("long").alias("n_seeds"))
    null_safe = [points[c].eqNullSafe(ends[c]) for c in by]
    cond = null_safe[0]
    for extra in null_safe[1:]:
        cond = cond & extra
    return points.join(ends, cond, "left").select(
        *[points[c] for c in by], f"{prefix}_mean", f"{prefix}_lo", f"{prefix}_hi", "n_seeds"
    )


def pair_models(results: DataFrame, cell: Sequence[str], first: str, second: str,
                values: Sequence[str] = ("pr_auc", "lift")) -> DataFrame:
    """Rows of two models side by side on (cell, seed); only seeds present in both."""
    def pick(model: str, v: str) -> Column:
        return F.max(F.when(F.col("model") == model, F.col(v)))

    sides = results.filter(F.col("model").isin(first, second)).groupBy(*cell, "seed").agg(
        *[pick(first, v).alias(f"{v}_first") for v in values],
        *[pick(second, v).alias(f"{v}_second") for v in values],
        F.count_distinct("model").alias("_models"),
    )
    return sides.filter("_models = 2").drop("_models")


def paired_delta(results: DataFrame, cell: Sequence[str], first: str, second: str, value: str = "pr_auc",
                 n_boot: int = 5000, seed: int = 0) -> DataFrame:
    """Mean of first minus second over shared seeds, with interval, class and claim columns."""
    both = pair_models(results, cell, first, second, (value,))
    deltas = both.withColumn("delta", F.col(f"{value}_first") - F.col(f"{value}_second"))
    out = seed_bootstrap(deltas, cell, "delta", "delta", n_boot=n_boot, seed=seed)
    return with_interval_words(out, "delta_mean", "delta_lo", "delta_hi")


def with_interval_words(rows: DataFrame, mean: str, lo: str, hi: str) -> DataFrame:
    """A: interval above 0; C: below 0; B: includes 0. Plus status, claim flag and Yes/No/RF label.

    The class, status and label words are fixed values of the result tables.
    """
    m, l, h = F.col(mean), F.col(lo), F.col(hi)
    cls = F.when((l > 0) & (h > 0), "A").when((h < 0) & (l < 0), "C").otherwise("B")
    status = {"A": "SUPPORTED", "B": "NOT_SUPPORTED", "C": "RF_SUPPORTED"}
    above = F.coalesce(F.signum(m) > 0, F.lit(False))
    holds = above & (cls == "A")
    words = F.create_map(*[F.lit(x) for pair in status.items() for x in pair])
    # A positive mean whose interval is not above zero is "No", and so is a mean that is not known.
    label = F.when(holds, "Yes").when(above | m.isNull(), "No").otherwise("RF")
    return rows.withColumns({"interval_class": cls, "interval_status": F.element_at(words, cls), "holds": holds, "hold_label": label})
