"""Stored tables: naming, creating, opening and adding rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators.merge import INSERT_KEYS, new_rows
from lodestone.schema import vector_table


def table_location(root: str, source: str) -> str:
    """Where the table made from a source path is kept: ``root/x_db/x_table``."""
    base = source.rstrip("/").rsplit("/", 1)[-1] or "None"
    return f"{root.rstrip('/')}/{base}_db/{base}_table"


def fitted(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns in the order and types of a schema."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def create_table(
    spark: SparkSession, target: str, rows: DataFrame | None = None, partition_by: Sequence[str] = ()
) -> None:
    """Create or replace a table; without rows it starts empty."""
    if rows is None:
        rows = spark.createDataFrame([], vector_table())
    rows.write.mode("overwrite").option("compression", "zstd").partitionBy(*partition_by).parquet(target)


def open_table(spark: SparkSession, target: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(target)


def insert_rows(
    spark: SparkSession,
    target: str,
    rows: DataFrame,
    keys: Sequence[str] = INSERT_KEYS,
    partition_by: Sequence[str] = (),
) -> None:
    """Add the rows whose key the table does not hold yet.

    Only new rows are written; what the table holds is read (its key columns)
    but not rewritten.
    """
    held = open_table(spark, target)
    added = new_rows(held, rows, keys).select(*held.columns)
    added.write.mode("append").partitionBy(*partition_by).parquet(target)


def published(spark: SparkSession, target: str) -> tuple[int, list[str]]:
    """The number of a table's current version and the loads it is made of; 0 and none before the first."""
    try:
        versions = spark.read.schema("number long, loads array<string>").parquet(f"{target}/versions")
        last = versions.orderBy(F.desc("number")).limit(2).collect()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, []
    if len(last) == 2 and last[0].number == last[1].number:
        raise ValueError(f"two writers published version {last[0].number} of {target}")
    return (last[0].number, list(last[0].loads)) if last else (0, [])


def publish(spark: SparkSession, target: str, loads: Sequence[str], after: int) -> None:
    """Make ``loads`` the current version of a table, the one that follows ``after``.

    The pointer is one file that appears as a whole, after all the loads are
    written: until then, and for a reader that has opened the table, the version
    before it stands.
    """
    row = spark.createDataFrame([(after + 1, list(loads))], "number long, loads array<string>")
    row.coalesce(1).write.mode("append").parquet(f"{target}/versions")


def load_folder(target: str, name: str, load: str) -> str:
    """Where one load keeps the part ``name`` of a table."""
    return f"{target}/{name}/load={load}"


def open_loads(spark: SparkSession, target: str, name: str, loads: Sequence[str], schema: str | None = None) -> DataFrame:
    """The part ``name`` of a table, from all of ``loads``; ``schema`` where it may hold no row."""
    reader = spark.read.option("basePath", f"{target}/{name}")
    if schema is not None:
        reader = reader.schema(f"{schema}, load string")
    return reader.parquet(*[load_folder(target, name, load) for load in loads]).drop("load")
