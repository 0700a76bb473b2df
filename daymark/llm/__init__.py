"""Operators of a training-data pipeline over ``documents``, ``embeddings`` and ``pages``, and their queries.

Nothing else in the package imports this folder. ``register`` adds its queries and SQL to the given dictionaries.
"""

from __future__ import annotations


def register(queries: dict, oracles: dict) -> None:
    """Add the numbered queries and the pipeline, with the SQL of those that SQL can express."""
    import corpus_pipeline
    from daymark.llm.queries import ORACLES, QUERIES

    queries.update(QUERIES)
    oracles.update(ORACLES)
    queries["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL is not None:
        oracles["pipeline"] = corpus_pipeline.ORACLE_SQL
