"""Every query by name, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


def load_all() -> None:
    """Import the modules that hold queries."""
    from .operators import cards, codec, containers, containment, coverage, dedupe, details, geo, intervals, ledger, matching, privacy, prose, readmodel, records, resolution, resolve, store, text_queries, transports  # noqa: F401
    from .streaming import windows  # noqa: F401

