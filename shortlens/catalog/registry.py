"""Named queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shortlens.operators.aggregates import CHUNK_ROWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register `build(t)`, where t(table) loads a table of the folder and t.spark is the session."""

    def add(build):
        def run(spark: SparkSession, directory: str) -> DataFrame:
            return build(Tables(spark, directory))

        run.__name__ = run.__qualname__ = name
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql.strip()
        return build

    return add


def chunk_sql(key: str, order: str) -> str:
    """The chunk in which `nest` puts a row."""
    return f"(row_number() OVER (PARTITION BY {key} ORDER BY {order}) - 1) // {CHUNK_ROWS}"


class Tables:
    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")
