"""Turning lines into vectors through a pluggable embedder."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import split_lines
from lodestone.operators.postings import terms
from lodestone.schema import DIMENSION, EMBED_RESPONSE
from lodestone.session import ship_package, stored

#: A text of more than one row in so many is sent to the rows instead of being joined.
COMMON_SHARE = 1000


class Embedder(Protocol):
    """Adds a column of vectors of ``dimension`` numbers to a frame of texts."""

    model: str
    dimension: int
    #: Whether a text costs a call of a model, so that no text should be embedded twice.
    calls_model: bool

    def embed(self, df: DataFrame, text: str, vector: str) -> DataFrame: ...


class HashingEmbedder:
    """Unit-length hashed term counts; a text without terms becomes zeros."""

    calls_model = False

    def __init__(self, dimension: int = DIMENSION, model: str = "hashed-terms"):
        self.dimension, self.model = dimension, model

    def embed(self, df: DataFrame, text: str, vector: str) -> DataFrame:
        steps = [
            HashingTF(inputCol="_terms", outputCol="_counts", numFeatures=self.dimension),
            Normalizer(inputCol="_counts", outputCol="_unit", p=2.0),
        ]
        made = df.withColumn("_terms", terms(F.coalesce(F.col(text), F.lit(""))))
        for step in steps:
            made = step.transform(made)
        made = made.withColumn(vector, vector_to_array(F.col("_unit"), "float32"))
        return made.drop("_terms", "_counts", "_unit")


class FunctionEmbedder:
    """Vectors from a function of a list of texts, called once per Arrow batch.

    ``start`` runs once per task and returns that function, so a model is
    loaded per task and not per batch.
    """

    calls_model = True

    def __init__(
        self,
        start: Callable[[], Callable[[list[str]], Sequence[Sequence[float]]]],
        dimension: int,
        model: str,
        batch: int = 256,
    ):
        self.start, self.dimension, self.model, self.batch = start, dimension, model, batch

    def embed(self, df: DataFrame, text: str, vector: str) -> DataFrame:
        ship_package(df.sparkSession)
        start, size, dimension = self.start, self.batch, self.dimension

        @F.arrow_udf("array<float>")
        def call(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            model = start()
            for texts in batches:
                held = texts.to_pylist()
                rows: list = []
                for first in range(0, len(held), size):
                    rows.extend(model(held[first : first + size]))
                if len(rows) != len(held):
                    raise ValueError("the embedder returned another number of vectors")
                flat = np.asarray(rows, np.float32).reshape(len(rows), dimension)
                offsets = np.arange(len(rows) + 1, dtype=np.int32) * dimension
                yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.ravel()))

        return df.withColumn(vector, call(F.coalesce(F.col(text), F.lit(""))))


def embed_column(
    df: DataFrame, text: str, embedder: Embedder, vector: str = "vector", tasks: int | None = None
) -> DataFrame:
    """Adds the vector of each text; ``tasks`` bounds the parallel model calls."""
    if tasks:
        df = df.repartition(tasks)
    return embedder.embed(df, text, vector)


def text_digest(text: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def embed_distinct(
    df: DataFrame,
    text: str,
    embedder: Embedder,
    vector: str = "vector",
    tasks: int | None = None,
    known: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``df`` with the vector of each text, and the vectors by text: ``digest, vector``.

    The model is called once for every distinct text that ``known`` (such vectors
    of earlier calls) does not hold; its answers are stored before they are used,
    so a lost executor repeats no call. Texts are told apart by their SHA-256. A
    text of more than a thousandth of all rows, of which there can be no more
    than a thousand, is not joined by key but sent to the rows.
    """
    texts = stored(df, "texts")
    keyed = texts.withColumn("_digest", text_digest(text))
    # grouped by the text itself, of which each task then sends one row; its digest is made afterwards
    distinct = texts.groupBy(F.coalesce(F.col(text), F.lit("")).alias("_text")).agg(F.count(F.lit(1)).alias("_rows"))
    distinct = distinct.withColumn("_digest", text_digest("_text"))
    fresh, held = distinct, None
    if known is not None:
        distinct = stored(distinct, "distinct-texts")
        known = known.select(F.col("digest").alias("_digest"), F.col("vector").alias(vector))
        fresh = distinct.join(known, "_digest", "left_anti")
        held = distinct.select("_digest", "_rows").join(known, "_digest")
    made = embed_column(fresh, "_text", embedder, vector, tasks).select("_digest", "_rows", vector)
    vectors = stored(made if held is None else made.unionByName(held.select("_digest", "_rows", vector)), "vectors")
    share = F.lit(vectors.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0] / COMMON_SHARE)
    common = F.broadcast(vectors.where(F.col("_rows") > share).select("_digest", vector))
    rare = vectors.where(F.col("_rows") <= share).select("_digest", vector)
    rows = keyed.join(common, "_digest").unionByName(
        keyed.join(common.select("_digest"), "_digest", "left_anti").join(rare, "_digest")
    )
    return rows.drop("_digest"), vectors.select(F.col("_digest").alias("digest"), F.col(vector).alias("vector"))


def embed_requests(
    chunks: DataFrame,
    model: str,
    text: str = "chunk",
    metadata: str = "metadata",
    chunk_number: str = "chunk_number",
) -> DataFrame:
    """One request per chunk, its lines as input: ``request`` and its JSON ``body``."""
    request = F.struct(
        F.lit(model).alias("model"),
        split_lines(F.col(text)).alias("input"),
        F.col(metadata).alias("metadata"),
        F.col(chunk_number).cast("int").alias("chunk_number"),
    )
    return chunks.withColumn("request", request).withColumn("body", F.to_json("request"))


def parse_response(body: Column) -> Column:
    return F.from_json(body, EMBED_RESPONSE)


def paired_lines(
    df: DataFrame, keep: Sequence[str] = (), strict: bool = True
) -> DataFrame:
    """Rows of ``request`` and ``response``: one row per vector with its line.

    Lines beyond the number of vectors are cut. A response without vectors is
    an error, or is dropped when not ``strict`` (see ``empty_responses``).
    """
    vectors = F.col("response.embeddings")
    if strict:
        missing = F.raise_error(F.lit("no vectors in the response"))
        vectors = F.when(F.size(vectors) > 0, vectors).otherwise(
            missing.cast("array<array<float>>")
        )
    lines = F.slice(F.col("request.input"), 1, F.size(vectors))
    pairs = F.posexplode(F.arrays_zip(lines.alias("line"), vectors.alias("vector")))
    return df.select(
        *keep,
        F.coalesce("request.metadata", F.lit("Empty")).alias("metadata"),
        F.coalesce("request.chunk_number", F.lit(0)).alias("chunk_number"),
        F.col("request.model").alias("model"),
        pairs.alias("line_no", "_pair"),
    ).select(
        *keep,
        "metadata",
        "chunk_number",
        "model",
        "line_no",
        F.col("_pair.line").alias("content"),
        F.col("_pair.vector").alias("vector"),
    )


def empty_responses(df: DataFrame) -> DataFrame:
    """The rows whose response holds no vectors."""
    size = F.size(F.col("response.embeddings"))
    return df.where(F.coalesce(size <= 0, F.lit(True)))


def load_time() -> Column:
    """The time of the load in whole seconds, one value per query."""
    return F.date_trunc("second", F.current_timestamp()).cast("timestamp_ntz")


def checked_width(df: DataFrame, dimension: int, vector: str = "vector") -> DataFrame:
    """``df``, failing on a vector of another width."""
    failed = F.raise_error(F.concat(F.lit("vector width is not "), F.lit(str(dimension))))
    right = F.col(vector).isNull() | (F.size(vector) == dimension)
    return df.withColumn(
        vector, F.when(right, F.col(vector)).otherwise(failed.cast("array<float>"))
    )


def wrong_width(df: DataFrame, dimension: int, vector: str = "vector") -> DataFrame:
    return df.where(F.col(vector).isNotNull() & (F.size(vector) != dimension))
