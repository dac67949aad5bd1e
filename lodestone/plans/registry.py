"""The runnable queries over the given tables, each with its SQL where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.files import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def registered(sql: str | None = None):
    """Register a query under its function name, with SQL that gives the same rows."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def wide_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table spread over all cores, for work that is heavy per row."""
    return spread(table(spark, folder, name))


def rounded(column: str, name: str, digits: int = 6):
    return F.round(F.col(column), digits).alias(name)
