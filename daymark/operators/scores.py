"""Scores without a trained model: how far a user-day lies above the training set's average."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daymark.operators.detectors import Fitted
from daymark.operators.features import clip, scale_statistics
from daymark.operators.ordered import attach_groups
from daymark.schema import BASE_COLUMNS, COUNT_COLUMNS

GROUPS = {"counts": COUNT_COLUMNS, "all": BASE_COLUMNS}


def deviation_scores(targets: DataFrame, train: DataFrame, by: Sequence[str],
                     groups: dict[str, list[str]] = GROUPS) -> DataFrame:
    """Sum of the clipped standardised features of each target row, on the scale of its training set.

    ``by`` names the training set on both sides; its statistics are one row per training set.
    """
    return scores_on(targets, scale_statistics(train, BASE_COLUMNS, by), by, groups)


def scores_on(targets: DataFrame, stats: DataFrame, by: Sequence[str], groups: dict[str, list[str]] = GROUPS) -> DataFrame:
    """``deviation_scores`` with given statistics."""
    scaled = attach_groups(targets, stats, by)
    z = {c: clip((F.col(c) - F.col(f"mean_{c}")) / F.col(f"std_{c}")) for c in BASE_COLUMNS}
    variants = F.array(
        *[F.struct(F.lit(name).alias("model"), F.round(sum((z[c] for c in cols[1:]), z[cols[0]]), 6).alias("score"))
          for name, cols in groups.items()]
    )
    keep = [c for c in targets.columns if c not in BASE_COLUMNS]
    return scaled.select(*keep, F.inline(variants))


class DeviationDetector:
    """The same score behind the interface of detectors: statistics of the training rows, no labels."""

    def __init__(self, columns: Sequence[str] = BASE_COLUMNS):
        self.columns = list(columns)

    def fit(self, train: DataFrame) -> Fitted:
        row = scale_statistics(train, self.columns).first()
        if row[f"mean_{self.columns[0]}"] is None:  # no training rows
            return Fitted(lambda rows: rows.withColumn("score", F.lit(None).cast("double")))
        z = [clip((F.col(c) - F.lit(float(row[f"mean_{c}"]))) / F.lit(float(row[f"std_{c}"]))) for c in self.columns]
        return Fitted(lambda rows: rows.withColumn("score", F.round(sum(z[1:], z[0]), 6)))
