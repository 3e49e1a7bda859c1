"""Queries by name, each with the same question in DuckDB's SQL where SQL can ask it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quizmill.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, views: str = ""):
    """Register the function under its name. ``views``: the study tables that the SQL reads."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            bodies = [f"{v} AS ({tables.SQL[v]})" for v in views.split()]
            text = sql.strip()
            if bodies:
                text = f"WITH {', '.join(bodies)}, {text[4:].lstrip()}" if text.upper().startswith("WITH") else f"WITH {', '.join(bodies)} {text}"
            SQL[f.__name__] = text
        return f

    return add
