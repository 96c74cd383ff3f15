"""All registered queries of the library and the SQL that they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from railside.plans.racing import Racing, with_racing

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def racing_query(name: str, sql: str | None = None, **params):
    """Register an operator over a Racing warehouse, with the parameters that its query uses."""

    def register(operator):
        QUERIES[name] = lambda spark, sf_dir: operator(Racing.from_tables(spark, sf_dir), **params)
        if sql:
            ORACLES[name] = with_racing(sql)
        return operator

    return register


def table_query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir)."""

    def register(query: Query) -> Query:
        QUERIES[name] = query
        if sql:
            ORACLES[name] = sql
        return query

    return register


def load() -> None:
    """Import the modules that register queries."""
    from railside import functions, operators, sources, streaming  # noqa: F401
    from railside.functions import queries as _functions  # noqa: F401
    from railside.operators import angle, audit, bias, joins, market, mutations, profile, race, reports, search, shapes, windows  # noqa: F401
    from railside.sources import order_books, pages, racecards, result_pages  # noqa: F401
    from railside.sources import queries as _sources  # noqa: F401
    from railside.streaming import ticks  # noqa: F401
