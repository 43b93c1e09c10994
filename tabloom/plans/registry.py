"""Named queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabloom.session import load

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register the decorated (spark, folder) -> DataFrame under `name`."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


class Frame:
    """A projection of one given table, written once for both engines."""

    def __init__(self, table: str, *exprs: str, where: str | None = None):
        self.table, self.exprs, self.where = table, exprs, where

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        df = load(spark, folder, self.table)
        if self.where:
            df = df.where(self.where)
        return df.selectExpr(*self.exprs)

    @property
    def sql(self) -> str:
        tail = f" WHERE {self.where}" if self.where else ""
        return f"SELECT {', '.join(self.exprs)} FROM {self.table}{tail}"
