"""Registered queries: a Spark callable over a table folder, and the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECK_SQL: dict[str, str] = {}


class Tables:
    """The driver tables of one folder; t.orders reads orders.parquet."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register fn(Tables) under a name, with check SQL where SQL can express it over whole tables."""

    def register(fn: Callable[[Tables], DataFrame]):
        from panelwright.session import tune

        QUERIES[name] = lambda spark, folder: fn(Tables(tune(spark), folder))
        if sql is not None:
            CHECK_SQL[name] = sql
        return fn

    return register
