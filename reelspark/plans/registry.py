"""Registered queries: name -> builder of (spark, folder), and name -> SQL for another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reelspark.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """Tables of a folder by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        ship(spark)
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self._spark.read.parquet(f"{self._folder}/{name}.parquet")

    @property
    def spark(self) -> SparkSession:
        return self._spark


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of Tables; sql is its equivalent."""

    def wrap(build: Callable[[Tables], DataFrame]):
        key = name or build.__name__
        QUERIES[key] = lambda spark, folder: build(Tables(spark, folder))
        if sql:
            SQL[key] = sql
        return build

    return wrap
