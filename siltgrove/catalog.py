"""The queries over the engine's own operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import queries_search, queries_text, queries_tree, queries_vector

GROUPS = (queries_text, queries_vector, queries_search, queries_tree)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query by its name; each runs over its whole tables."""
    return {q.__name__: q for g in GROUPS for q in g.QUERIES}


def oracle_sql() -> dict[str, str]:
    """The SQL of those queries that SQL can express."""
    return {k: v for g in GROUPS for k, v in g.SQL.items()}
