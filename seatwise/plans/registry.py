"""How a query is registered: a Spark callable over a data folder, and the DuckDB text that must return the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seatwise.plans.views import table, view

Query = Callable[[SparkSession, str], DataFrame]


class Inputs:
    """Lazy access to the views and base tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._seen = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._seen:
            self._seen[name] = view(self.spark, self.sf_dir, name)
        return self._seen[name]

    def base(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


class Registry:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def register(build: Callable[[Inputs], DataFrame]):
            self.queries[name] = lambda spark, sf_dir: build(Inputs(spark, sf_dir))
            if sql is not None:
                self.oracles[name] = sql
            return build
        return register
