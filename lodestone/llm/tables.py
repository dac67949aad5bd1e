"""Small helpers that the operators share: inputs, stored steps, registration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.arrow import BLOCK_BYTES
from lodestone.session import scratch_path, ship_package

BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"

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


def ready(spark: SparkSession) -> None:
    """The package in the workers, and rows sent to them in batches of bounded size, however long the texts."""
    ship_package(spark)
    spark.conf.set(BATCH_CONF, str(BLOCK_BYTES))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, safe from lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, so that no further column can clash or be read."""
    return docs.select("doc_id", "text")


def packed(docs: DataFrame, *names: str) -> DataFrame:
    """The rows as one struct ``row`` beside the columns ``names``, so that no other column can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *names)


def input_partitions(docs: DataFrame) -> int:
    """Shuffle partitions of the session, the measure of how far work is spread."""
    return int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def no_rows(df: DataFrame) -> bool:
    return df.limit(1).count() == 0


__all__ = [
    "F",
    "ORACLE",
    "QUERIES",
    "input_partitions",
    "no_rows",
    "packed",
    "ready",
    "registered",
    "stored",
    "table",
    "texts",
]
