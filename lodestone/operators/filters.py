"""Filters, memberships, caps and projections of retrieval."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import marked, parsed_int, trim_space
from lodestone.session import has_at_most

# Members of a list small enough to send to every task.
MEMBERS = 100_000


def with_content(df: DataFrame, content: str = "content") -> DataFrame:
    return df.where(F.col(content).isNotNull())


def members(df: DataFrame, column: str, values: DataFrame | Sequence) -> DataFrame:
    """Rows whose ``column`` is among ``values`` (a list or a one-column frame)."""
    if not isinstance(values, DataFrame):
        values = list(values)
        return df.where(F.col(column).isin(values)) if values else df.where(F.lit(False))
    wanted = values.select(F.col(values.columns[0]).alias(column)).distinct()
    if has_at_most(wanted, MEMBERS):
        wanted = F.broadcast(wanted)
    return df.join(wanted, column, "left_semi")


def chunk_members(df: DataFrame, column: str, texts: DataFrame) -> DataFrame:
    """Rows whose chunk number is among numbers given as text; other text means 0."""
    values = texts.select(parsed_int(F.col(texts.columns[0])).alias("value"))
    return members(df, column, values)


def row_cap(df: DataFrame, order: Sequence[Column | str], n: int | None) -> DataFrame:
    """The first ``n`` rows in a fixed order; all rows when ``n`` is None."""
    return df if n is None else df.orderBy(*order).limit(n)


def file_names(df: DataFrame, column: str = "metadata") -> DataFrame:
    """The distinct file names, without the missing ones."""
    return df.where(F.col(column).isNotNull()).select(column).distinct()


def as_text(df: DataFrame, column: str) -> DataFrame:
    """One column as text, nulls marked; only text and 32-bit columns allowed."""
    if column not in df.columns:
        return df.sparkSession.createDataFrame([], f"`{column}` string")
    kind = df.schema[column].dataType.simpleString()
    if kind not in ("string", "int"):
        raise TypeError(f"unsupported column type: {kind}")
    return df.select(marked(F.col(column)).alias(column))


def checked_queries(queries: DataFrame, text: str = "text", strict: bool = False) -> DataFrame:
    """Queries that hold text; ``strict`` fails on an empty one instead."""
    filled = F.coalesce(trim_space(F.col(text)) != "", F.lit(False))
    if not strict:
        return queries.where(filled)
    failed = F.raise_error(F.lit("query text is empty")).cast("string")
    return queries.withColumn(text, F.when(filled, F.col(text)).otherwise(failed))
