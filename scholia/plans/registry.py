"""How a query and its SQL oracle are registered together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scholia.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """Tables of a folder by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)


class Registry:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable:
        """Register a function of ``Tables`` under a name, with the SQL that gives the same rows."""

        def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
            self.queries[name] = lambda spark, folder: f(Tables(spark, folder))
            if sql:
                self.oracles[name] = sql
            return f

        return add
