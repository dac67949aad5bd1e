"""Merging new rows into a table by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The columns that make two rows the same in the two merges.
UPSERT_KEYS = ("id", "content")
CONTENT_KEYS = ("content", "metadata", "vector", "model", "chunk_number")
# Equal lines of two files, or two lines of one file, are different rows.
INSERT_KEYS = (*CONTENT_KEYS, "path", "line_no")


def _key_hash(keys: Sequence[str]):
    return F.xxhash64(*keys)


def _absent(rows: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` whose key does not occur in ``other``; null equals null.

    Keys of ``other`` are reduced to one row each before they are shuffled, so
    a key that fills a third of it costs a task no more than any other.
    """
    left = rows.withColumn("_hash", _key_hash(keys)).alias("l")
    right = other.select(*keys).withColumn("_hash", _key_hash(keys)).distinct().alias("r")
    same = F.col("l._hash") == F.col("r._hash")
    for key in keys:
        same = same & F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}"))
    return left.join(right, same, "left_anti").drop("_hash")


def checked_unique(source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``source``, failing when a key occurs twice."""
    others = [c for c in source.columns if c not in keys]
    value = F.struct(*others) if others else F.struct(F.lit(0).alias("_none"))
    grouped = source.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"), F.any_value(value).alias("_value")
    )
    once = F.when(F.col("_rows") == 1, F.col("_value")).otherwise(
        F.raise_error(F.lit("a key occurs twice in the rows to merge"))
    )
    taken = grouped.withColumn("_value", once)
    return taken.select(*[F.col(f"_value.{c}") if c in others else F.col(c) for c in source.columns])


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str] = UPSERT_KEYS) -> DataFrame:
    """``target`` with the rows of ``source`` put in or put in place by key."""
    source = checked_unique(source, keys)
    return _absent(target, source, keys).unionByName(source)


def new_rows(target: DataFrame, source: DataFrame, keys: Sequence[str] = INSERT_KEYS) -> DataFrame:
    """The rows of ``source`` whose key is not in ``target`` yet."""
    return _absent(source, target, keys)


def insert_if_absent(
    target: DataFrame, source: DataFrame, keys: Sequence[str] = INSERT_KEYS
) -> DataFrame:
    """``target`` and the new rows of ``source``; rows of ``target`` never change."""
    return target.unionByName(new_rows(target, source, keys))
