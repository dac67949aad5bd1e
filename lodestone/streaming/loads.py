"""Loading files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lodestone.functions.text import base_name, language_of
from lodestone.operators.embedding import Embedder
from lodestone.plans.jobs import load_more
from lodestone.schema import CHUNK_OVERLAP, CHUNK_SIZE, PARTITIONS
from lodestone.sources.files import name_pattern

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def arriving_files(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the files of known types below a folder."""
    files = (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", name_pattern())
        .load(path)
    )
    return files.select(
        "path",
        base_name(F.col("path")).alias("metadata"),
        language_of(F.col("path")).alias("language"),
        F.decode(F.col("content"), "UTF-8").alias("text"),
    ).where(F.col("language").isNotNull())


def insert_stream(
    files: DataFrame,
    target: str,
    embedder: Embedder,
    checkpoint: str,
    chunk_size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    partitions: int = PARTITIONS,
) -> DataStreamWriter:
    """Insert the lines of each micro-batch into a table, with its indexes.

    The first batch makes the table if there is none. A batch that is replayed
    after a failure adds nothing, since only absent rows are inserted and each
    batch is published in one step. Ids follow those that the table holds.
    """

    def add(batch: DataFrame, _number: int) -> None:
        load_more(batch.sparkSession, batch, target, embedder, chunk_size, overlap, partitions)

    return files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
