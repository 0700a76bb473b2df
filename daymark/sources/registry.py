"""Loaders by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from daymark.sources import cert, lanl, optc, spedia

LOADERS = {"cert": cert.load, "lanl": lanl.load, "optc": optc.load, "spedia": spedia.load}


def load(spark: SparkSession, name: str, path: str, **options) -> DataFrame:
    """Canonical events of a named source."""
    if name not in LOADERS:
        raise ValueError(f"unknown source {name!r}; known: {sorted(LOADERS)}")
    return LOADERS[name](spark, path, **options)
