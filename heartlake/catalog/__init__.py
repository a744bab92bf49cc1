"""Named queries over the input tables, each with its SQL where SQL can say it.

A module adds to a ``Catalog`` by decorating functions ``(spark, root) ->
DataFrame``; ``sql`` is the same query for DuckDB.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"two queries are named {name}")
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = sql
            return f

        return add

    def update(self, other: Catalog) -> None:
        for name, f in other.queries.items():
            self.query(name, other.sql.get(name))(f)
