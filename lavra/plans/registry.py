"""Registry of queries: name to (query, SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries with the SQL that gives the same rows, where SQL can say it."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, query: Query, sql: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"query {name} is registered twice")
        self.queries[name] = query
        if sql:
            self.sql[name] = sql

    def query(self, sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
        """Decorator: registers the function under its own or the given name."""

        def wrap(f: Query) -> Query:
            self.add(name or f.__name__, f, sql)
            return f

        return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
