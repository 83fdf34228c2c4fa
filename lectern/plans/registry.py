"""The registry of queries, and what their SQL shares."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.catalog import Catalog

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | Callable[[], str] | None = None):
    """Register a query under its name, with the SQL that says the same if there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql if isinstance(sql, str) else sql()
        return f

    return add


def dim_sql(catalog: Catalog) -> str:
    """The catalog as a table of SQL."""
    rows = ", ".join(f"({b.ord}, '{b.usfm_id}', '{b.category}', {list(b.verse_counts)}::INTEGER[])" for b in catalog.books)
    return f"dim(ord, usfm_id, category, counts) AS (VALUES {rows})"
