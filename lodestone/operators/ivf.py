"""Approximate search: coarse partitions, byte codes and re-ranking.

Centroids and code ranges are small by construction (partitions x dimension
and 2 x dimension numbers) and travel to the tasks as values; vectors stay in
their table, which is best written with ``partitionBy("part")``.
"""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.vectors import cosine_distance, l2_distance, l2_squared
from lodestone.operators import neighbours as nn
from lodestone.operators.joins import join_same
from lodestone.operators.ordering import top_k
from lodestone.schema import (
    MAX_ITERATIONS,
    NEIGHBOURS,
    PARTITIONS,
    PROBES,
    REFINE_FACTOR,
    SAMPLE_RATE,
)
from lodestone.session import checkpointed, ship_package

# Sampled rows per training task.
SAMPLE_TASK = 4096
# Most numbers a set of centroids may have to be sent to every task.
CENTROID_NUMBERS = 8 << 20


@dataclass(frozen=True)
class Centroids:
    """Cluster centres, one row per partition; ``unit`` for unit-length input.

    ``parts`` holds the numbers of the partitions, 0, 1, 2, ... by default.
    """

    matrix: np.ndarray
    unit: bool = False
    parts: np.ndarray | None = None

    def __post_init__(self):
        if self.matrix.size > CENTROID_NUMBERS:
            raise ValueError("too many centroids to send to every task")

    @property
    def numbers(self) -> np.ndarray:
        return np.arange(len(self.matrix)) if self.parts is None else self.parts

    def _gaps(self, vectors: np.ndarray) -> np.ndarray:
        """Squared distance to every centre, less the square of the vector."""
        rows = vectors.astype(np.float64)
        if self.unit:
            lengths = np.linalg.norm(rows, axis=1, keepdims=True)
            rows = rows / np.where(lengths > 0, lengths, 1.0)
        return np.einsum("ij,ij->i", self.matrix, self.matrix) - 2 * rows @ self.matrix.T

    def nearest(self, vectors: np.ndarray) -> np.ndarray:
        return self.numbers[np.argmin(self._gaps(vectors), axis=1)]

    def probes(self, vectors: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` closest partitions of each vector, closest first."""
        return self.numbers[np.argsort(self._gaps(vectors), axis=1, kind="stable")[:, :n]]

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i, row.tolist()) for i, row in zip(self.numbers.tolist(), self.matrix)]
        return spark.createDataFrame(rows, "part int, centroid array<double>")

    @classmethod
    def from_frame(cls, frame: DataFrame, unit: bool = False) -> Centroids:
        """Centres from rows ``(part, centroid)``; their size is checked before they are read."""
        numbers = frame.agg(F.sum(F.size("centroid"))).first()[0] or 0
        if numbers > CENTROID_NUMBERS:
            raise ValueError("too many centroids to send to every task")
        rows = frame.orderBy("part").collect()
        parts = np.array([row["part"] for row in rows], np.int64)
        return cls(np.array([row["centroid"] for row in rows], np.float64), unit, parts)


def _whole(table: DataFrame, vector: str, unit: bool, dimension: int | None) -> DataFrame:
    """Rows with a complete vector, for ``unit`` one that is not zero."""
    width = F.size(vector)
    kept = table.where(
        F.col(vector).isNotNull()
        & (width > 0 if dimension is None else width == dimension)
        & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    )
    return kept.where(F.exists(vector, lambda x: x != 0)) if unit else kept


def _known(column: pa.Array, width: int, unit: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values of the vectors that ``_whole`` keeps."""
    rows, vectors = nn.vectors_of(column, width)
    good = np.isfinite(vectors).all(axis=1)
    if unit:
        good &= (vectors != 0).any(axis=1)
    return rows[good], vectors[good]


def train_centroids(
    table: DataFrame,
    vector: str = "vector",
    partitions: int = PARTITIONS,
    sample_rate: int = SAMPLE_RATE,
    max_iterations: int = MAX_ITERATIONS,
    unit: bool = True,
    seed: int = 0,
    rows: int | None = None,
    dimension: int | None = None,
) -> Centroids:
    """Cluster centres from a sample of about ``partitions * sample_rate`` rows.

    ``unit`` scales vectors to length 1 first: Euclidean order then equals
    cosine order. ``rows``, the number of usable vectors, saves counting them;
    ``dimension`` leaves out vectors of another width.
    """
    usable = _whole(table, vector, unit, dimension).select(
        F.col(vector).cast("array<double>").alias("_vector")
    )
    if rows is None:
        rows = usable.count()
    if rows == 0:
        raise ValueError("no vectors to train on")
    wanted = partitions * sample_rate
    if rows > wanted:
        usable = usable.sample(withReplacement=False, fraction=wanted / rows, seed=seed)
    points = usable.select(array_to_vector("_vector").alias("_raw"))
    if unit:
        points = Normalizer(inputCol="_raw", outputCol="_point", p=2.0).transform(points)
    else:
        points = points.withColumnRenamed("_raw", "_point")
    # The sample is small whatever the table holds: a few tasks per iteration
    # do, and it is stored so that no iteration goes back to the table.
    points = checkpointed(points.select("_point").repartition(1 + min(rows, wanted) // SAMPLE_TASK))
    clusters = min(partitions, rows)
    if clusters == 1:
        mean = points.select(Summarizer.mean(F.col("_point")).alias("m")).first()["m"]
        return Centroids(mean.toArray()[None, :], unit)
    model = KMeans(
        k=clusters, maxIter=max_iterations, seed=seed, featuresCol="_point"
    ).fit(points)
    return Centroids(np.array(model.clusterCenters()), unit)


def assign_partitions(
    table: DataFrame, centroids: Centroids, vector: str = "vector", name: str = "part"
) -> DataFrame:
    """Adds the closest partition; null where no vector can be found."""
    ship_package(table.sparkSession)
    shared = table.sparkSession.sparkContext.broadcast(centroids)

    @F.arrow_udf("int")
    def closest(column: pa.Array) -> pa.Array:
        return _parts(shared.value, *_known(column, shared.value.matrix.shape[1], shared.value.unit), len(column))

    return table.withColumn(name, closest(F.col(vector)))


def _parts(held: Centroids, rows: np.ndarray, vectors: np.ndarray, size: int) -> pa.Array:
    parts = np.zeros(size, np.int32)
    known = np.zeros(size, bool)
    if len(rows):
        parts[rows] = held.nearest(vectors)
        known[rows] = True
    return pa.array(parts, pa.int32(), mask=~known)


def _ranges(batches: Iterable[pa.RecordBatch], unit: bool, dimension: int | None) -> Iterator[pa.RecordBatch]:
    """Smallest and largest value per dimension of the vectors of a task, and how many they are."""
    low = high = None
    count = 0
    for batch in batches:
        column = batch.column(0)
        widths = np.unique(pc.list_value_length(column).drop_null().to_numpy()) if dimension is None else [dimension]
        for width in widths:
            rows, vectors = nn.vectors_of(column, int(width))
            good = ~np.isnan(vectors).any(axis=1)
            if unit:
                good &= (vectors != 0).any(axis=1)
            vectors = vectors[good]
            if not vectors.size:
                continue
            if low is None:
                low, high = vectors.min(axis=0), vectors.max(axis=0)
            elif len(low) != width:
                raise ValueError("vectors of several widths")
            low, high = np.minimum(low, vectors.min(axis=0)), np.maximum(high, vectors.max(axis=0))
            count += len(vectors)
    if count:
        columns = [np.arange(len(low), dtype=np.int32), low, high, np.full(len(low), count)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["dim", "low", "high", "n"])


@dataclass(frozen=True)
class Quantizer:
    """Byte codes over the range of each dimension.

    ``unit``: the codes serve cosine search, where a zero vector has no
    distance; it then gets no codes, since they would not decode to zero.
    """

    low: np.ndarray
    high: np.ndarray
    unit: bool = False
    rows: int | None = None

    @classmethod
    def fit(
        cls,
        table: DataFrame,
        vector: str = "vector",
        unit: bool = False,
        dimension: int | None = None,
    ) -> Quantizer:
        """Smallest and largest value per dimension and the rows, in one pass.

        A task sends one row per dimension. Vectors are those that ``_whole`` keeps.
        """
        ship_package(table.sparkSession)
        ranges = table.select(F.col(vector).cast("array<double>")).mapInArrow(
            lambda batches: _ranges(batches, unit, dimension), "dim int, low double, high double, n long"
        )
        found = ranges.groupBy("dim").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
        rows = found.orderBy("dim").collect()
        if not rows:
            raise ValueError("no vectors to index")
        if len({r["n"] for r in rows}) > 1:
            raise ValueError("vectors of several widths")
        return cls(np.array([r["low"] for r in rows]), np.array([r["high"] for r in rows]), unit, rows[0]["n"])

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        width = self.high - self.low
        safe = np.where(width > 0, width, 1.0)
        codes = np.floor((vectors.astype(np.float64) - self.low) / safe * 255)
        return np.where(width > 0, np.clip(codes, 0, 255), 0).astype(np.int16)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.low + codes.astype(np.float64) * ((self.high - self.low) / 255)

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(self.low, self.high))]
        return spark.createDataFrame(rows, "dim int, low double, high double")

    @classmethod
    def from_frame(cls, frame: DataFrame, unit: bool = False) -> Quantizer:
        if not nn.has_at_most(frame, CENTROID_NUMBERS):
            raise ValueError("too many dimensions to send to every task")
        rows = frame.orderBy("dim").collect()
        low, high = ([r[name] for r in rows] for name in ("low", "high"))
        return cls(np.array(low), np.array(high), unit)


def encode_vectors(
    table: DataFrame, quantizer: Quantizer, vector: str = "vector", name: str = "codes"
) -> DataFrame:
    """Adds the codes of each vector; null where no vector can be found."""
    ship_package(table.sparkSession)
    shared = table.sparkSession.sparkContext.broadcast(quantizer)

    @F.arrow_udf("array<smallint>")
    def coded(column: pa.Array) -> pa.Array:
        return _codes(shared.value, *_known(column, len(shared.value.low), shared.value.unit), len(column))

    return table.withColumn(name, coded(F.col(vector)))


def _codes(held: Quantizer, rows: np.ndarray, vectors: np.ndarray, size: int) -> pa.Array:
    known = np.zeros(size, bool)
    known[rows] = True
    offsets = np.zeros(size + 1, np.int32)
    offsets[1:] = np.cumsum(known) * len(held.low)
    codes = pa.array(held.encode(vectors).ravel(), pa.int16())
    return pa.ListArray.from_arrays(pa.array(offsets), codes, mask=pa.array(~known))


def place_and_encode(
    table: DataFrame,
    centroids: Centroids,
    quantizer: Quantizer,
    vector: str = "vector",
    part: str = "part",
    codes: str = "codes",
) -> DataFrame:
    """``assign_partitions`` and ``encode_vectors`` in one step, so that vectors go to Python once."""
    if (centroids.unit, centroids.matrix.shape[1]) != (quantizer.unit, len(quantizer.low)):
        raise ValueError("centroids and codes are of other vectors")
    ship_package(table.sparkSession)
    shared = table.sparkSession.sparkContext.broadcast((centroids, quantizer))

    @F.arrow_udf("part int, codes array<smallint>")
    def made(column: pa.Array) -> pa.Array:
        places, ranges = shared.value
        known = _known(column, len(ranges.low), places.unit)
        columns = [_parts(places, *known, len(column)), _codes(ranges, *known, len(column))]
        return pa.StructArray.from_arrays(columns, ["part", "codes"])

    # called once for both columns: the optimizer copies only what it takes for deterministic
    found = table.withColumn("_made", made.asNondeterministic()(F.col(vector)))
    return found.withColumn(part, F.col("_made.part")).withColumn(codes, F.col("_made.codes")).drop("_made")


def _search(
    table, queries, search, keys, vector, query_id, query_vector, max_query_bytes,
    centroids=None, nprobes=PROBES, part="part", decode=None,
) -> tuple[DataFrame, DataFrame, nn.QuerySet | None]:
    """Best rows per query over all of the table or over the probed partitions.

    Also returns the table without the partitions no query looks into, and the
    queries if they were small enough to hold.
    """
    schema = nn._result_schema(table, queries, keys, query_id)
    width = centroids.matrix.shape[1] if decode is None else len(decode.low)
    queries = nn.of_width(queries, query_vector, width)
    held = nn.collect_queries(queries, query_id, query_vector, search.k, width, max_query_bytes)
    if held is None:
        probes = None
        if centroids is not None:
            queries, probes = _with_probes(queries, centroids, nprobes, query_vector), "_probes"
            queries = queries.where(F.col(probes).isNotNull())
            table = table.where(F.col(part).isNotNull())
        found = nn.grid_nearest(
            table, queries, search, schema, keys, vector, query_id, query_vector, width,
            max_query_bytes, part if probes else None, probes, decode,
        )
    else:
        if centroids is not None and len(held.vectors):
            wanted = centroids.probes(held.vectors, nprobes)
            table = table.where(F.col(part).isin([int(p) for p in np.unique(wanted)]))
            held = nn.QuerySet(held.ids, held.vectors, nn.probe_mask(wanted.tolist()))
        found = nn.scan_nearest(
            table, held, search, schema, keys, vector, query_id,
            part if held.probes is not None else None, decode,
        )
    return top_k(found, [query_id], [nn.DISTANCE, *keys], search.k), table, held


def _with_probes(queries, centroids, nprobes, query_vector) -> DataFrame:
    ship_package(queries.sparkSession)
    shared = queries.sparkSession.sparkContext.broadcast(centroids)

    @F.arrow_udf("array<int>")
    def closest(column: pa.Array) -> pa.Array:
        held = shared.value
        rows, vectors = nn.vectors_of(column, held.matrix.shape[1])
        lists: list = [None] * len(column)
        if len(rows):
            for row, parts in zip(rows, held.probes(vectors, nprobes).tolist()):
                lists[row] = parts
        return pa.array(lists, pa.list_(pa.int32()))

    return queries.withColumn("_probes", closest(F.col(query_vector)))


def probed_nearest(
    table: DataFrame,
    centroids: Centroids,
    queries: DataFrame,
    k: int = NEIGHBOURS,
    nprobes: int = PROBES,
    *,
    key: str | Sequence[str] = "row_key",
    vector: str = "vector",
    part: str = "part",
    query_id: str = "query_id",
    query_vector: str = "vector",
    metric: str = "cosine",
    max_query_bytes: int = nn.QUERY_BYTES,
) -> DataFrame:
    """Nearest rows among the ``nprobes`` partitions closest to each query.

    Probing all partitions gives the exact answer.
    """
    keys = [key] if isinstance(key, str) else list(key)
    found, _, _ = _search(
        table, queries, nn.Search(k, metric), keys, vector, query_id, query_vector,
        max_query_bytes, centroids, nprobes, part,
    )
    return found


EXACT = {"cosine": cosine_distance, "l2": l2_distance, "l2_squared": l2_squared}


def refined_nearest(
    table: DataFrame,
    quantizer: Quantizer,
    queries: DataFrame,
    k: int = NEIGHBOURS,
    factor: int = REFINE_FACTOR,
    *,
    centroids: Centroids | None = None,
    nprobes: int = PROBES,
    key: str | Sequence[str] = "row_key",
    vector: str = "vector",
    codes: str = "codes",
    part: str = "part",
    query_id: str = "query_id",
    query_vector: str = "vector",
    metric: str = "cosine",
    max_query_bytes: int = nn.QUERY_BYTES,
) -> DataFrame:
    """``k * factor`` rows by the distance of their codes, then the best ``k`` exactly.

    The wide scan reads the byte codes; full vectors are read only to be
    joined with the candidates, and only from the probed partitions.
    """
    keys = [key] if isinstance(key, str) else list(key)
    search = nn.Search(k * factor, metric)
    found, table, held = _search(
        table, queries, search, keys, codes, query_id, query_vector, max_query_bytes,
        centroids, nprobes, part, quantizer,
    )
    found = found.select(query_id, *keys)
    full = table.select(*keys, F.col(vector).alias("_full"))
    if held is not None:
        small = len(held.ids) * search.k <= nn.BROADCAST_ROWS
        full = join_same(full, found, keys, small)
        exact = nn.measured(full, held, metric, "_full", query_id)
    else:
        asked = queries.select(query_id, F.col(query_vector).alias("_asked"))
        full = join_same(full, join_same(found, asked, [query_id]), keys)
        exact = full.withColumn(nn.DISTANCE, EXACT[metric](F.col("_full"), F.col("_asked")))
    exact = exact.where(F.col(nn.DISTANCE).isNotNull()).select(query_id, *keys, nn.DISTANCE)
    return top_k(exact, [query_id], [nn.DISTANCE, *keys], k)
