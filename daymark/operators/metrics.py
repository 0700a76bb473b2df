"""Ranking metrics as aggregations over (group, score) counts.

Scores are folded to counts per distinct score first. Running totals come from
:mod:`daymark.operators.ordered`, so neither a large group nor a large tie lands in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daymark.operators.ordered import attach_groups, ranked, running, slices


def score_counts(scored: DataFrame, by: Sequence[str], times: str | None = None) -> DataFrame:
    """Positives and negatives of every score; ``times`` names a column that says for how many rows a row stands."""
    if times is None:
        count = F.count_if
    else:
        count = lambda here: F.coalesce(F.sum(F.when(here, F.col(times))), F.lit(0).cast("long"))
    return scored.groupBy(*by, "score").agg(count(F.col("label") == 1).alias("pos"), count(F.col("label") == 0).alias("neg"))


def ranked_scores(scored: DataFrame, by: Sequence[str], times: str | None = None) -> DataFrame:
    """Per distinct score: positives and negatives at or above it (``tp``, ``fp``) and the group totals."""
    out = running(score_counts(scored, by, times), by, [F.desc("score")], {"pos": F.col("pos"), "neg": F.col("neg")})
    return out.withColumnsRenamed({"run_pos": "tp", "run_neg": "fp", "all_pos": "n_pos", "all_neg": "n_neg"})


def _negative_at(index: Column) -> Column:
    """Score of the negative at an ascending 0-based position."""
    below = F.col("n_neg") - F.col("fp")
    return F.max(F.when((below <= index) & (index < below + F.col("neg")), F.col("score")))


def _false_positive_threshold(fpr: float) -> Column:
    position = (F.col("n_neg") - 1) * F.lit(1.0 - fpr)
    lo, hi = F.floor(position), F.ceil(position)
    weight = F.max(position - lo)
    return _negative_at(lo) + (_negative_at(hi) - _negative_at(lo)) * weight


def curve_metrics(ranked_rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Average precision, ROC area and the thresholds at 1% and 5% false positives."""
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    worse = F.col("n_neg") - F.col("fp") + F.col("neg") / 2
    return ranked_rows.groupBy(*by).agg(
        F.sum(F.when(both, F.col("pos") / F.col("n_pos") * precision)).alias("pr_auc"),
        F.sum(F.when(both, F.col("pos") / F.col("n_pos") * (worse / F.col("n_neg")))).alias("roc_auc"),
        F.max("n_pos").alias("n_pos"),
        F.max("n_neg").alias("n_neg"),
        _false_positive_threshold(0.01).alias("thr_1pct"),
        _false_positive_threshold(0.05).alias("thr_5pct"),
    )


def detection_rates(ranked_rows: DataFrame, curves: DataFrame, by: Sequence[str]) -> DataFrame:
    """Share of positives at or above the false-positive thresholds."""
    def rate(thr: str) -> Column:
        hit = F.sum(F.when(F.col("score") >= F.col(thr), F.col("pos")).otherwise(0))
        usable = (F.max("n_pos") > 0) & (F.max("n_neg") > 0)
        return F.when(usable, hit / F.max("n_pos"))

    marks = curves.select(*by, "thr_1pct", "thr_5pct")
    return attach_groups(ranked_rows, marks, by).groupBy(*by).agg(
        rate("thr_1pct").alias("dr_at_1pct_fpr"), rate("thr_5pct").alias("dr_at_5pct_fpr")
    )


def precision_at_k(scored: DataFrame, ranked_rows: DataFrame, by: Sequence[str], order: Sequence[str],
                   k: int | None = None) -> DataFrame:
    """Precision of the k best rows, k = number of positives by default, within [1, n].

    Counts settle every score above the cut; only the rows tied at the cut are ordered, by ``order``.
    """
    n = F.col("n_pos") + F.col("n_neg")
    wanted = F.greatest(F.lit(1), F.least(F.col("n_pos") if k is None else F.lit(k), n))
    upto = F.col("tp") + F.col("fp")
    above = upto - F.col("pos") - F.col("neg")
    edge = ranked_rows.filter((above < wanted) & (wanted <= upto)).select(
        *by, "score", wanted.alias("k"), (wanted - above).alias("need"), (F.col("tp") - F.col("pos")).alias("pos_above")
    )
    ties = scored.select(*dict.fromkeys([*by, "score", "label", *order])).join(edge, [*by, "score"])
    taken = ranked(ties, by, [F.col(c) for c in order]).filter(F.col("rank") <= F.col("need"))
    return taken.groupBy(*by).agg(
        ((F.max("pos_above") + F.sum("label")) / F.max("k")).alias("precision_at_k"), F.max("k").alias("k")
    )


def metric_bundle(scored: DataFrame, by: Sequence[str], order: Sequence[str] = ("user", "day")) -> DataFrame:
    """All ranking metrics for every group of ``by``; undefined ones are null."""
    r = ranked_scores(scored, by)
    curves = curve_metrics(r, by)
    rates = detection_rates(r, curves, by)
    top = precision_at_k(scored, r, by, order)
    n = F.col("n_pos") + F.col("n_neg")
    return (
        curves.join(rates, list(by))
        .join(top, list(by))
        .withColumn("n", n)
        .withColumn("base_rate", F.col("n_pos") / n)
        .withColumn("lift", F.when(F.col("n_pos") > 0, F.col("pr_auc") / (F.col("n_pos") / n)))
        .select(*by, "pr_auc", "roc_auc", "dr_at_1pct_fpr", "dr_at_5pct_fpr", "precision_at_k", "base_rate",
                "lift", "n", "n_pos")
    )


def pr_roc(scored: DataFrame, by: Sequence[str], times: str | None = None) -> DataFrame:
    """Average precision, ROC area, base rate and lift only: one pass fewer than the bundle."""
    n = F.col("n_pos") + F.col("n_neg")
    return curve_metrics(ranked_scores(scored, by, times), by).select(
        *by, "pr_auc", "roc_auc", (F.col("n_pos") / n).alias("base_rate"),
        F.when(F.col("n_pos") > 0, F.col("pr_auc") / (F.col("n_pos") / n)).alias("lift"),
        n.alias("n"), "n_pos",
    )


# ---- stratified bootstrap -----------------------------------------------------------------------


def _resample_slice(metric: str, n_boot: int, seed: int, by: Sequence[str]):
    """Contribution of one slice of the ranking to every replicate.

    A stratified resample is one multinomial draw per class. It is drawn in two exact steps: totals per
    slice (the same seeded draw in every slice of a group), then counts inside the slice.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("score", ascending=False)
        layout = pdf["layout"].iloc[0]
        totals = np.array([[s["pos"], s["neg"]] for s in layout], dtype=np.int64)
        ids = [s["slice"] for s in layout]
        here = ids.index(pdf["slice"].iloc[0])
        group = zlib.crc32("|".join(str(pdf[c].iloc[0]) for c in by).encode())
        n_pos, n_neg = totals.sum(axis=0)
        picks, before = [], []
        for cls, total in enumerate((n_pos, n_neg)):
            if total == 0:
                picks.append(np.zeros(n_boot, dtype=np.int64))
                before.append(np.zeros(n_boot, dtype=np.int64))
                continue
            draws = np.random.default_rng([seed, group, cls]).multinomial(total, totals[:, cls] / total, size=n_boot)
            picks.append(draws[:, here])
            before.append(draws[:, :here].sum(axis=1))
        counts = pdf[["pos", "neg"]].to_numpy(dtype=np.float64).T
        shares = [c / c.sum() if c.sum() else c for c in counts]
        rng = np.random.default_rng([seed, group, 2 + here])
        parts = np.zeros(n_boot)
        if n_pos and n_neg:
            for b in range(n_boot):
                pos = rng.multinomial(picks[0][b], shares[0]) if picks[0][b] else np.zeros(len(pdf))
                neg = rng.multinomial(picks[1][b], shares[1]) if picks[1][b] else np.zeros(len(pdf))
                tp = before[0][b] + np.cumsum(pos)
                fp = before[1][b] + np.cumsum(neg)
                hit = pos > 0
                if metric == "pr_auc":
                    parts[b] = (pos[hit] * tp[hit] / (tp[hit] + fp[hit])).sum() / n_pos
                else:
                    parts[b] = (pos[hit] * (n_neg - fp[hit] + neg[hit] / 2)).sum() / (n_pos * n_neg)
        else:
            parts[:] = np.nan
        out = pd.DataFrame({"replicate": np.arange(n_boot), "part": parts})
        for c in by:
            out[c] = pdf[c].iloc[0]
        return out[[*by, "replicate", "part"]]

    return run


def bootstrap_interval(scored: DataFrame, by: Sequence[str], metric: str = "pr_auc", n_boot: int = 1000,
                       alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """Point value and percentile interval of a metric; positives and negatives are resampled separately."""
    sliced = slices(score_counts(scored, by), by, [F.desc("score")])
    layout = sliced.groupBy(*by, "slice").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    layout = layout.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("slice", "pos", "neg"))).alias("layout"))
    types = dict(sliced.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in by] + ["replicate long", "part double"])
    parts = (
        sliced.join(layout, list(by))
        .groupBy(*by, "slice")
        .applyInPandas(_resample_slice(metric, n_boot, seed, by), schema)
    )
    replicates = parts.groupBy(*by, "replicate").agg(F.sum("part").alias("value"))
    value = F.when(~F.isnan("value"), F.col("value"))
    ends = replicates.groupBy(*by).agg(
        F.percentile(value, alpha / 2).alias("lo"),
        F.percentile(value, 1 - alpha / 2).alias("hi"),
        F.count(value).alias("n_replicates"),
    )
    point = pr_roc(scored, by).select(*by, F.col(metric).alias("point"))
    return point.join(ends, list(by))
