"""Reading the driver's tables, and collecting queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table, or some of its columns: what else it has is not read."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


class Plans:
    """Named queries; ``add`` is a decorator that takes the SQL of the same rows, if SQL has it."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def put(f):
            self.queries[name] = f
            if sql is not None:
                self.oracles[name] = sql
            return f

        return put
