"""Registered queries over the analytic tables, each with the SQL that checks it where SQL can."""

from daymark.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "load_all"]


def load_all() -> None:
    """Import every module that registers queries."""
    from daymark.queries import (  # noqa: F401
        detection, evaluation, explanation, features, population, results, sequences, shift, sources, streams,
    )
