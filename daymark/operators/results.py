"""Result tables: one row per (model, source, target, protocol, seed), and what is derived from them."""

from __future__ import annotations

from collections.abc import Sequence

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daymark.functions.hashing import digest
from daymark.operators.intervals import seed_bootstrap
from daymark.operators.labels import last_by_key
from daymark.operators.ordered import attach_groups
from daymark.session import fixed

CELL = ["model", "source", "target", "protocol", "seed"]
LONG_COLUMNS = {
    "source": "string", "target": "string", "model": "string", "seed": "int", "pr_auc": "double",
    "roc_auc": "double", "prevalence": "double", "lift": "double", "diagonal_protocol": "string",
    "cell_kind": "string", "wall_s": "double", "peak_rss_gb": "double", "n_pos": "long",
    "n_pos_source": "long", "n_pos_target": "long", "epochs": "int",
}


def job_grid(spark: SparkSession, models: Sequence[str], domains: Sequence[str], seeds: Sequence[int],
             protocols: Sequence[str] = ("user_disjoint", "temporal")) -> DataFrame:
    """All cells of an experiment: off-diagonal once, diagonal once per protocol."""
    rows = []
    for m in models:
        for s in domains:
            for t in domains:
                for p in protocols if s == t else ("full_source",):
                    rows += [(m, s, t, p, int(k)) for k in seeds]
    return spark.createDataFrame(rows, "model string, source string, target string, protocol string, seed int")


def missing_cells(grid: DataFrame, finished: DataFrame) -> DataFrame:
    """Cells of the grid without a finished row."""
    return grid.join(finished.select(*CELL).distinct(), CELL, "left_anti")


def keep_best(rows: DataFrame, key: Sequence[str] = CELL, order: str = "run") -> DataFrame:
    """One row per cell: rows with a ROC value first, then the latest run."""
    return last_by_key(rows, list(key), [F.col("roc_auc").isNotNull().cast("int").desc(), F.desc(order)])


def long_form(rows: DataFrame) -> DataFrame:
    """Fixed columns of the published result table; absent ones are null."""
    kind = F.when(F.col("source") == F.col("target"), "diagonal").otherwise("off_diagonal")
    derived = {"prevalence": F.col("base_rate"), "diagonal_protocol": F.col("protocol"), "cell_kind": kind}
    return rows.select(
        *[
            (F.col(c) if c in rows.columns else derived.get(c, F.lit(None))).cast(t).alias(c)
            for c, t in LONG_COLUMNS.items()
        ]
    )


def cell_means(rows: DataFrame, by: Sequence[str] = ("model", "source", "target", "protocol"),
               evaluable: Sequence[str] = ()) -> DataFrame:
    """Mean and spread over seeds per cell."""
    return rows.groupBy(*by).agg(
        F.avg("pr_auc").alias("pr_auc_mean"),
        F.stddev_samp("pr_auc").alias("pr_auc_sd"),
        F.avg("lift").alias("lift_mean"),
        F.avg("base_rate").alias("base_rate"),
        F.avg("n").alias("n"),
        F.avg("n_pos").alias("n_pos"),
        F.count_distinct("seed").alias("n_seeds"),
    ).withColumn("evaluable_target", F.col("target").isin(list(evaluable)))


def seed_summary(rows: DataFrame, by: Sequence[str], n_boot: int = 5000, digits: int = 6) -> DataFrame:
    """Mean with seed bootstrap interval of PR-AUC and lift, and the values in seed order as text."""
    pr = seed_bootstrap(rows, by, "pr_auc", "pr_auc", n_boot=n_boot, seed=0)
    lift = seed_bootstrap(rows, by, "lift", "lift", n_boot=n_boot, seed=1).drop("n_seeds")
    text = rows.groupBy(*by).agg(
        F.avg("base_rate").alias("base_rate"),
        F.array_sort(F.collect_list(F.struct("seed", "pr_auc"))).alias("p"),
    ).select(
        *by, "base_rate",
        F.array_join(F.transform("p", lambda x: F.when(x["pr_auc"].isNull(), "nan").otherwise(F.format_string(f"%.{digits}f", x["pr_auc"]))), ";")
        .alias("pr_auc_seeds"),
    )
    return pr.join(lift, list(by)).join(text, list(by))


# ---- gaps -----------------------------------------------------------------------------------------

def _diagonal() -> Column:
    return F.col("source") == F.col("target")


def plain_gap(rows: DataFrame, value: str = "pr_auc", by: Sequence[str] = ("model",)) -> DataFrame:
    """Mean of the diagonal minus mean of the rest; nulls are ignored."""
    v = F.col(value)
    diag, off = F.avg(F.when(_diagonal(), v)), F.avg(F.when(~_diagonal(), v))
    return rows.groupBy(*by).agg(diag.alias("diag_mean"), off.alias("off_mean"), (diag - off).alias("gap"))


def protocol_gap(rows: DataFrame, protocol: str = "user_disjoint", evaluable: Sequence[str] | None = None,
                 by: Sequence[str] = ("model",)) -> DataFrame:
    """Gap over cells after averaging seeds; with ``evaluable``, only over those targets.

    The diagonal uses one protocol; every source that reaches an evaluable target counts.
    """
    cells = rows.filter(~_diagonal() | (F.col("protocol") == protocol))
    if evaluable is not None:
        cells = cells.filter(F.col("target").isin(list(evaluable)))
    means = cells.groupBy(*by, "source", "target").agg(F.avg("pr_auc").alias("v"))
    diag, off = F.avg(F.when(_diagonal(), F.col("v"))), F.avg(F.when(~_diagonal(), F.col("v")))
    return means.groupBy(*by).agg(
        F.count(F.when(_diagonal(), F.col("v"))).alias("n_diag"),
        F.count(F.when(~_diagonal(), F.col("v"))).alias("n_pairs"),
        diag.alias("diag_mean"), off.alias("off_mean"), (diag - off).alias("gap"),
    )


def matrix_view(rows: DataFrame, domains: Sequence[str], value: str = "pr_auc",
                by: Sequence[str] = ("model", "protocol")) -> DataFrame:
    """Source x target matrix of the mean value, one row per source."""
    return rows.groupBy(*by, "source").pivot("target", list(domains)).agg(F.avg(value))


def matched_cells(rows: DataFrame, first: str, second: str, evaluable: Sequence[str]) -> DataFrame:
    """Off-diagonal cells that both models have, seeds averaged, and whether the target is evaluable."""
    def mean_of(model: str) -> Column:
        return F.avg(F.when(F.col("model") == model, F.col("pr_auc")))

    off = rows.filter(~_diagonal() & F.col("model").isin(first, second))
    return (
        off.groupBy("source", "target")
        .agg(mean_of(first).alias("first"), mean_of(second).alias("second"), F.count_distinct("model").alias("_models"))
        .filter("_models = 2")
        .drop("_models")
        .withColumn("evaluable_target", F.col("target").isin(list(evaluable)))
    )


def distance_with_lift(rows: DataFrame, distances: DataFrame) -> DataFrame:
    """Directed off-diagonal lift next to the distance of the unordered domain pair (``a`` < ``b``)."""
    off = rows.filter(~_diagonal()).groupBy("model", "source", "target").agg(F.avg("lift").alias("lift"))
    ends = off.withColumn("a", F.least("source", "target")).withColumn("b", F.greatest("source", "target"))
    ordered = distances.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance")
    return ends.join(ordered, ["a", "b"]).drop("a", "b")


# ---- tests over cells -----------------------------------------------------------------------------


def _upper_normal(z: Column) -> Column:
    """Upper tail of the standard normal distribution."""

    @F.pandas_udf("double")
    def tail(x: pd.Series) -> pd.Series:
        return pd.Series(np.frompyfunc(math.erfc, 1, 1)(x.to_numpy(float) / math.sqrt(2)).astype(float) / 2).where(x.notna().to_numpy())

    return tail(z)


def average_rank(value: Column, *by: str) -> Column:
    """Rank with ties averaged, ascending, inside ``by``. For small tables such as features or cells."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2


def wilcoxon(pairs: DataFrame, first: str = "first", second: str = "second", by: Sequence[str] = ()) -> DataFrame:
    """One-sided signed-rank test that ``first`` is larger; zero differences are dropped.

    Without ties the p value is exact for any number of pairs: the null distribution of the rank sum is folded rank by rank, each rank
    counting with chance one half. With ties it is normal with tie correction. Pairs are result cells, so there are few.
    """
    by = list(by)
    d = pairs.select(*by, (F.col(first) - F.col(second)).alias("d")).filter("d <> 0")
    if not by:
        d = d.withColumn("_all", F.lit(1))
    keys = by or ["_all"]
    d = d.withColumn("mag", F.abs("d")).withColumn("r", average_rank(F.col("mag"), *keys))
    d = d.withColumn("t", F.count(F.lit(1)).over(Window.partitionBy(*keys, "mag")))
    stats = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("w"),
        F.sum((F.col("t") * F.col("t") - 1) / 48).alias("tie_term"),
        F.max("t").alias("max_tie"),
        F.array_sort(F.collect_list("r")).alias("ranks"),  # one per cell
    )
    n = F.col("n_pairs")
    mean = n * (n + 1) / 4
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("tie_term")
    stats = stats.withColumn("p_normal", _upper_normal((F.col("w") - mean) / F.sqrt(var)))
    zeros = lambda r: F.array_repeat(F.lit(0.0), r.cast("int"))
    chances = F.aggregate(
        F.col("ranks"), F.array(F.lit(1.0)),
        lambda acc, r: F.zip_with(F.concat(acc, zeros(r)), F.concat(zeros(r), acc), lambda out, with_r: (out + with_r) / 2),
    )
    upper = F.aggregate(F.slice(chances, F.col("w").cast("int") + 1, F.size(chances)), F.lit(0.0), lambda acc, p: acc + p)
    out = stats.withColumn("p_exact", F.when(F.col("max_tie") == 1, upper)).withColumn("p_value", F.coalesce("p_exact", "p_normal"))
    return out.select(*by, "n_pairs", "w", "p_value", F.col("p_exact").isNotNull().alias("exact"))


def pearson(pairs: DataFrame, x: str, y: str, order: Sequence[str], by: Sequence[str] = (), n_perm: int = 999,
            seed: int = 0) -> DataFrame:
    """Correlation over result cells, with a two-sided permutation p value.

    Permutation b orders the cells by md5 of ``seed:b:position``.
    """
    by = list(by)
    keyed = pairs.withColumn("_all", F.lit(1)) if not by else pairs
    keys = by or ["_all"]
    lists = keyed.groupBy(*keys).agg(
        F.corr(x, y).alias("r"),
        F.count(F.lit(1)).alias("n_cells"),
        F.array_sort(F.collect_list(F.struct(*order, F.col(x).alias("_x"), F.col(y).alias("_y")))).alias("cells"),
    )
    perms = lists.select(*keys, "r", "cells", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))).alias("b"))
    shuffled = F.transform(
        F.array_sort(F.transform("cells", lambda c, i: F.struct(digest(seed, F.col("b"), i).alias("k"), c["_y"].alias("y")))),
        lambda s: s["y"],
    )
    drawn = perms.select(*keys, "r", "b", F.inline(F.arrays_zip(F.transform("cells", lambda c: c["_x"]).alias("px"), shuffled.alias("py"))))
    drawn = drawn.toDF(*keys, "r", "b", "px", "py")
    per = drawn.groupBy(*keys, "b").agg(F.first("r").alias("r"), F.corr("px", "py").alias("rb"))
    p = per.groupBy(*keys).agg(
        ((F.count_if(F.abs("rb") >= F.abs("r") - 1e-12) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value")
    )
    return lists.join(p, keys).select(*by, "n_cells", "r", "p_value")


def spearman(rows: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    by = list(by)
    keyed = rows if by else rows.withColumn("_all", F.lit(1))
    keys = by or ["_all"]
    ranked = keyed.select(*keys, average_rank(F.col(x), *keys).alias("rx"), average_rank(F.col(y), *keys).alias("ry"))
    return ranked.groupBy(*keys).agg(F.corr("rx", "ry").alias("rho"), F.count(F.lit(1)).alias("n")).select(*by, "rho", "n")


# ---- guards ---------------------------------------------------------------------------------------


def leakage_flags(rows: DataFrame) -> DataFrame:
    """Results that are too good: a diagonal from 0.95, a saturated diagonal, an off-diagonal from 0.999."""
    pr = F.col("pr_auc")
    return (
        rows.withColumn("inspect_diagonal", F.coalesce(_diagonal() & (pr >= 0.95), F.lit(False)))
        .withColumn("stop_saturated", F.coalesce(_diagonal() & (pr >= 0.9999), F.lit(False)))
        .withColumn("stop_off_diagonal", F.coalesce(~_diagonal() & (pr >= 0.999), F.lit(False)))
    )


def fail_on_leakage(rows: DataFrame) -> None:
    bad = leakage_flags(rows).filter("stop_saturated OR stop_off_diagonal").select(*CELL, "pr_auc").limit(5).collect()
    if bad:
        raise ValueError(f"suspiciously perfect cells: {bad}")


def drift_check(rows: DataFrame, expected: DataFrame, tolerance: float = 0.08, min_seeds: int = 5,
                by: Sequence[str] = ("model", "source", "target", "protocol")) -> DataFrame:
    """Cell means against reference means; judged once enough seeds are there."""
    by = list(by)
    now = rows.groupBy(*by).agg(F.avg("pr_auc").alias("pr_auc_mean"), F.count("pr_auc").alias("n_seeds"))
    diff = F.col("pr_auc_mean") - F.col("expected")
    return now.join(expected, by).withColumn("difference", diff).withColumn(
        "status",
        F.when(F.col("n_seeds") < min_seeds, "too_few_seeds").when(F.abs(diff) <= tolerance, "ok").otherwise("drift"),
    )


def integrity(predictions: DataFrame, by: Sequence[str] = CELL) -> DataFrame:
    """Row counts, positives, non-finite scores and repeated user-days of each prediction cell.

    A user-day is in many cells. It is moved once, with a bit for each cell it was seen in: if it has as many rows as bits, no cell holds it twice. Only
    the other user-days are counted cell by cell. Cells that share a bit, as some of very many do, only make more of them.
    """
    by = list(by)
    score = F.col("score")
    finite = score.isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf"))
    cell = F.xxhash64(*by).alias("_cell")
    cells = fixed(predictions.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("n_pos"), F.count_if(~finite).alias("n_not_finite")))
    slots = cells.select(cell).distinct().withColumn("_slot", F.row_number().over(Window.orderBy("_cell")) - 1)  # one row a cell
    words = min(16, max(1, -(-cells.count() // 64)))
    place = F.pmod(F.col("_slot"), F.lit(64 * words))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    seen = [F.bit_or(F.when(F.floor(place / 64) == w, bit).otherwise(F.lit(0).cast("long"))).alias(f"_seen{w}") for w in range(words)]
    days = attach_groups(predictions.select("user", "day", cell), slots, ["_cell"]).groupBy("user", "day").agg(F.count(F.lit(1)).alias("_n"), *seen)
    counted = sum([F.bit_count(f"_seen{w}") for w in range(1, words)], F.bit_count("_seen0"))
    doubtful = fixed(days.filter(F.col("_n") != counted).select(F.col("user").alias("_user"), F.col("day").alias("_day")))
    total = cells.withColumn("n_repeated", F.lit(0).cast("long"))
    if not doubtful.isEmpty():
        again = predictions.join(doubtful, F.col("user").eqNullSafe(F.col("_user")) & F.col("day").eqNullSafe(F.col("_day")), "left_semi")
        per_row = again.groupBy(*by, "user", "day").agg(F.count(F.lit(1)).alias("n"), (F.sum("label") - F.max("label")).alias("more"))
        none = F.lit(0).cast("long")
        total = total.unionByName(per_row.groupBy(*by).agg(
            none.alias("n"), (-F.sum("more")).alias("n_pos"), none.alias("n_not_finite"), F.count_if(F.col("n") > 1).alias("n_repeated")))
        total = total.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("n", "n_pos", "n_not_finite", "n_repeated")])
    return total.withColumn("passed", (F.col("n_not_finite") == 0) & (F.col("n_repeated") == 0) & (F.col("n") > 0))


def tokens(rows: DataFrame, expected: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Named values ``prefix:cell-metric`` of a summary table, and the expected names that are absent."""
    cell = F.concat_ws("-", "model", "source", "target", "protocol")
    pairs = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(c).alias("v"), F.lit(d).alias("digits"))
          for m, c, d in (("pr", "pr_auc_mean", 3), ("lift", "lift_mean", 2))]
    )
    wide = rows.select(cell.alias("cell"), F.inline(pairs))
    text = F.when(F.col("digits") == 3, F.format_string("%.3f", "v")).otherwise(F.format_string("%.2f", "v"))
    found = wide.filter("v IS NOT NULL").select(
        F.concat_ws("-", F.concat(F.lit("T:"), "cell"), "metric").alias("token"), text.alias("value")
    )
    names = rows.sparkSession.createDataFrame([(e,) for e in expected], "token string")
    return found, names.join(found, "token", "left_anti")
