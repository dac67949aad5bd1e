"""Exact nearest-neighbour search over a table of vectors.

Each task walks its share of the table block by block, compares a block with
all queries by one matrix product and keeps the best ``k`` rows per query. Only
those leave the task, so vectors are never shuffled and no pair of row and
query becomes a Spark row. A query set too large to hold in memory is handled
by laying rows and queries out on a grid of bounded cells instead.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators.joins import join_same
from lodestone.operators.ordering import top_k
from lodestone.schema import NEIGHBOURS
from lodestone.session import has_at_most, ship_package

DISTANCE = "_distance"
METRICS = ("cosine", "l2", "l2_squared")

# Queries held by every task: vectors and running results stay below this.
QUERY_BYTES = 64 << 20
# Queries read in one go, before it is known whether there are more.
FIRST_QUERIES = 1024
# Bytes of the vectors that are measured exactly at a time, and pairs held before they are cut to the best.
PAIR_BYTES = 32 << 20
PAIRS = 1 << 18
# Rows of the result small enough to send to every task when joined back.
BROADCAST_ROWS = 200_000
# Queries compared with a block of rows at a time.
QUERY_BLOCK = 512


@dataclass(frozen=True)
class Search:
    """What one search keeps: the metric, the size and an optional range."""

    k: int = NEIGHBOURS
    metric: str = "cosine"
    min_distance: float | None = None
    max_distance: float | None = None

    def __post_init__(self):
        if self.metric not in METRICS:
            raise ValueError(f"unknown metric {self.metric!r}")
        if self.k < 1:
            raise ValueError("k must be at least 1")


@dataclass(frozen=True)
class QuerySet:
    """Query vectors as the tasks use them.

    ``probes[q, p]`` tells whether query ``q`` looks into partition ``p``.
    """

    ids: pa.Array
    vectors: np.ndarray
    probes: np.ndarray | None = None


def vectors_of(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row positions with a whole vector of ``width`` numbers, and those vectors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    sizes = np.diff(column.offsets.to_numpy())
    usable = (sizes == width) & column.is_valid().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(usable)
    flat = column.values.to_numpy(zero_copy_only=False)
    starts = column.offsets.to_numpy()[:-1][rows]
    if len(rows) == len(column):
        begin = starts[0] if len(rows) else 0
        matrix = flat[begin : begin + len(rows) * width].reshape(len(rows), width)
    else:
        matrix = flat[starts[:, None] + np.arange(width)]
    return rows, matrix


def exact_distance(metric, rows, row_lengths, asked, asked_lengths) -> np.ndarray:
    """Distance of each row to the query vector beside it, in double precision."""
    if metric == "cosine":
        return 1.0 - np.einsum("ij,ij->i", rows, asked) / (row_lengths * asked_lengths)
    gaps = rows - asked
    squares = np.einsum("ij,ij->i", gaps, gaps)
    return np.sqrt(squares) if metric == "l2" else squares


class Nearest:
    """The best rows per query seen so far by one task."""

    def __init__(self, queries: QuerySet, search: Search, keys: Sequence[str]):
        self.queries, self.search, self.keys = queries, search, list(keys)
        exact = queries.vectors.astype(np.float64)
        self.exact = exact
        lengths = np.sqrt(np.einsum("ij,ij->i", exact, exact))
        self.query_ok = np.isfinite(lengths)
        if search.metric == "cosine":
            self.query_ok &= lengths > 0
        self.query_length = np.where(lengths > 0, lengths, 1.0)
        scaled = exact / self.query_length[:, None] if search.metric == "cosine" else exact
        self.coarse = np.ascontiguousarray(scaled, dtype=np.float32)
        self.coarse_square = np.einsum("ij,ij->i", self.coarse, self.coarse)
        self.limit = np.full(len(exact), np.inf)
        self.best: pa.Table | None = None

    def add(self, keys: pa.Table, vectors: np.ndarray, parts: np.ndarray | None = None) -> None:
        """Compare a block of rows with every query that looks at it."""
        exact = vectors.astype(np.float64)
        lengths = np.sqrt(np.einsum("ij,ij->i", exact, exact))
        ok = np.isfinite(lengths)
        if self.search.metric == "cosine":
            ok &= lengths > 0
        found, pairs = [], 0
        for rows, wanted in self._probed(np.flatnonzero(ok), parts):
            for start in range(0, len(wanted), QUERY_BLOCK):
                asked = wanted[start : start + QUERY_BLOCK]
                for some in self._candidates(rows, asked, exact, lengths):
                    found.append(some)
                    pairs += len(some[0])
                    if pairs >= PAIRS:
                        self._take(keys, found)
                        found, pairs = [], 0
        if found:
            self._take(keys, found)

    def _take(self, keys: pa.Table, found) -> None:
        """Cut what is held and the candidates ``found`` to the best of each query."""
        row = np.concatenate([f[0] for f in found])
        query = np.concatenate([f[1] for f in found])
        distance = np.concatenate([f[2] for f in found])
        block = keys.take(pa.array(row))
        block = block.append_column("_query", pa.array(query, pa.int32()))
        self._merge(block.append_column(DISTANCE, pa.array(distance, pa.float64())))

    def _probed(self, rows, parts):
        """Row and query positions that have to be compared with each other."""
        wanted = np.flatnonzero(self.query_ok)
        if self.queries.probes is None or parts is None:
            return [(rows, wanted)] if len(rows) and len(wanted) else []
        pairs = []
        for part in np.unique(parts[rows]):
            if part >= self.queries.probes.shape[1]:
                continue
            looking = wanted[self.queries.probes[wanted, part]]
            if len(looking):
                pairs.append((rows[parts[rows] == part], looking))
        return pairs

    def _candidates(self, rows, wanted, exact, lengths):
        """Rows that may be among the best of each query, with exact distances, some pairs at a time.

        Single-precision products only preselect; the margin covers their
        rounding, and every candidate is measured again in double precision
        so that equal vectors get equal distances.
        """
        search, width = self.search, exact.shape[1]
        unit = (width + 8) * np.finfo(np.float32).eps
        if search.metric == "cosine":
            coarse = (exact[rows] / lengths[rows, None]).astype(np.float32)
            near = 1.0 - self.coarse[wanted] @ coarse.T
            margin = np.full(len(wanted), 2 * unit)
        else:
            coarse = exact[rows].astype(np.float32)
            square = np.einsum("ij,ij->i", coarse, coarse)
            near = self.coarse_square[wanted, None] + square[None, :]
            near -= 2 * (self.coarse[wanted] @ coarse.T)
            reach = lengths[rows].max() + self.query_length[wanted]
            margin = 2 * unit * reach * reach
        low, high = self._coarse_range()
        bound = self.limit[wanted]
        unbound = np.flatnonzero(np.isinf(bound))
        if len(unbound) and len(rows) > search.k:
            inside = near[unbound]
            if low is not None:
                inside = np.where(inside >= low + margin[unbound, None], inside, np.inf)
            kth = np.partition(inside, search.k - 1, axis=1)[:, search.k - 1]
            bound[unbound] = kth + margin[unbound]
        if high is not None:
            bound = np.minimum(bound, high)
        keep = near <= (bound + margin)[:, None]
        if low is not None:
            keep &= near >= (low - margin)[:, None]
        column, row = np.nonzero(keep)
        step = max(1, PAIR_BYTES // (16 * max(width, 1)))
        for start in range(0, len(row), step):
            yield self._measured(rows[row[start : start + step]], wanted[column[start : start + step]], exact, lengths)

    def _measured(self, row, query, exact, lengths):
        distance = self._exact(exact[row], lengths[row], query)
        good = np.ones(len(row), bool)
        if self.search.min_distance is not None:
            good &= distance >= self.search.min_distance
        if self.search.max_distance is not None:
            good &= distance <= self.search.max_distance
        return row[good], query[good], distance[good]

    def _coarse_range(self):
        low, high = self.search.min_distance, self.search.max_distance
        if self.search.metric == "l2":
            low = low if low is None else low * abs(low)
            high = high if high is None else high * abs(high)
        return low, high

    def _exact(self, rows, lengths, query):
        asked = self.exact[query]
        return exact_distance(
            self.search.metric, rows, lengths, asked, self.query_length[query]
        )

    def _merge(self, block: pa.Table) -> None:
        if self.best is not None:
            block = pa.concat_tables([self.best, block])
        order = [("_query", "ascending"), (DISTANCE, "ascending")]
        block = block.sort_by(order + [(key, "ascending") for key in self.keys])
        query = block["_query"].to_numpy()
        starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
        sizes = np.diff(np.r_[starts, len(query)])
        rank = np.arange(len(query)) - np.repeat(starts, sizes)
        kept = block.take(pa.array(np.flatnonzero(rank < self.search.k)))
        self.best = kept.combine_chunks()
        full = sizes >= self.search.k
        kth = block[DISTANCE].to_numpy()[starts[full] + self.search.k - 1]
        if self.search.metric == "l2":
            kth = kth * kth
        self.limit[query[starts[full]]] = kth

    def result(self, query_id: str) -> pa.Table | None:
        if self.best is None:
            return None
        ids = self.queries.ids.take(self.best["_query"].combine_chunks())
        columns = {query_id: ids}
        columns.update({key: self.best[key] for key in self.keys})
        columns[DISTANCE] = self.best[DISTANCE]
        return pa.table(columns)


def _result_schema(table: DataFrame, queries: DataFrame, keys, query_id) -> T.StructType:
    fields = [T.StructField(query_id, queries.schema[query_id].dataType)]
    fields += [T.StructField(key, table.schema[key].dataType) for key in keys]
    return T.StructType(fields + [T.StructField(DISTANCE, T.DoubleType())])


def widths_of(queries: DataFrame, query_vector: str) -> list[int]:
    """The widths of the query vectors, one as a rule."""
    size = F.size(query_vector).alias("n")
    found = queries.where(F.col(query_vector).isNotNull()).select(size).distinct().collect()
    return sorted(row["n"] for row in found if row["n"] > 0)


def of_width(queries: DataFrame, query_vector: str, width: int) -> DataFrame:
    """The queries that can be compared with vectors of ``width``."""
    return queries.where(F.col(query_vector).isNotNull() & (F.size(query_vector) == width))


def collect_queries(
    queries: DataFrame, query_id: str, query_vector: str, k: int, width: int, max_bytes: int = QUERY_BYTES
) -> QuerySet | None:
    """The query vectors of ``width`` on the driver, or None when they exceed ``max_bytes``.

    A few queries are read in one go; only if there are more is the rest read,
    and never more than one query beyond the bound.
    """
    asked = of_width(queries, query_vector, width).select(query_id, query_vector)
    table = asked.limit(FIRST_QUERIES + 1).toArrow()
    if not table.num_rows:
        return QuerySet(pa.array([], pa.int64()), np.zeros((0, 0), np.float32))
    rows = max(1, max_bytes // (width * 16 + k * 64))
    if FIRST_QUERIES < table.num_rows <= rows:
        table = asked.limit(rows + 1).toArrow()
    if table.num_rows > rows:
        return None
    usable, vectors = vectors_of(table[query_vector], width)
    ids = table[query_id].combine_chunks()
    if isinstance(ids, pa.ChunkedArray):
        ids = pa.concat_arrays(ids.chunks) if ids.num_chunks else pa.array([], ids.type)
    return QuerySet(ids.take(pa.array(usable)), vectors)


def few_queries(
    queries: DataFrame, query_id: str, query_vector: str, k: int, max_bytes: int = QUERY_BYTES
) -> list[QuerySet] | None:
    """The query vectors by their widths, from one read; None where they are many or exceed ``max_bytes``."""
    asked = queries.where(F.col(query_vector).isNotNull() & (F.size(query_vector) > 0))
    table = asked.select(query_id, query_vector).limit(FIRST_QUERIES + 1).toArrow()
    if table.num_rows > FIRST_QUERIES:
        return None
    ids, vectors = (pa.concat_arrays(c.chunks) if c.num_chunks else c.combine_chunks() for c in table.columns)
    found = []
    for width in np.unique(np.diff(vectors.offsets.to_numpy())) if len(vectors) else []:
        usable, matrix = vectors_of(vectors, int(width))
        if len(usable) > max(1, max_bytes // (int(width) * 16 + k * 64)):
            return None
        found.append(QuerySet(ids.take(pa.array(usable)), matrix))
    return found


def scan_nearest(
    table: DataFrame,
    queries: QuerySet,
    search: Search,
    schema: T.StructType,
    keys: Sequence[str],
    vector: str,
    query_id: str,
    part: str | None = None,
    decode=None,
) -> DataFrame:
    """Best rows per query and task; ``decode`` turns stored codes into vectors."""
    ship_package(table.sparkSession)
    shared = table.sparkSession.sparkContext.broadcast((queries, search, decode))
    keys = list(keys)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, wanted, decoder = shared.value
        nearest = Nearest(held, wanted, keys)
        for batch in batches:
            rows, vectors = vectors_of(batch.column(vector), held.vectors.shape[1])
            if not len(rows):
                continue
            if decoder is not None:
                vectors = decoder.decode(vectors)
            block = pa.Table.from_batches([batch.select(keys)])
            if len(rows) < batch.num_rows:
                block = block.take(pa.array(rows))
            parts = batch.column(part).to_numpy(zero_copy_only=False) if part else None
            nearest.add(block, vectors, None if parts is None else parts[rows].astype(int))
        found = nearest.result(query_id)
        if found is not None:
            yield from found.to_batches()

    columns = [*keys, vector] + ([part] if part else [])
    return table.select(*columns).mapInArrow(scan, schema)


def measured(
    df: DataFrame, queries: QuerySet, metric: str, vector: str, query_id: str
) -> DataFrame:
    """Adds the exact distance of each vector to the query named beside it."""
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast((queries, metric))

    @F.arrow_udf("double")
    def distance(vectors: pa.Array, ids: pa.Array) -> pa.Array:
        held, wanted = shared.value
        rows, exact = vectors_of(vectors, held.vectors.shape[1])
        at = pc.index_in(ids, value_set=held.ids.cast(ids.type)).take(pa.array(rows))
        exact = exact.astype(np.float64)
        asked = held.vectors[at.to_numpy(zero_copy_only=False).astype(int)].astype(np.float64)
        lengths, asked_lengths = (np.sqrt(np.einsum("ij,ij->i", x, x)) for x in (exact, asked))
        with np.errstate(divide="ignore", invalid="ignore"):
            found = exact_distance(wanted, exact, lengths, asked, asked_lengths)
        result = np.full(len(vectors), np.nan)
        result[rows] = found
        return pa.array(result, mask=~np.isfinite(result))

    return df.withColumn(DISTANCE, distance(F.col(vector), F.col(query_id)))


def grid_nearest(
    table: DataFrame,
    queries: DataFrame,
    search: Search,
    schema: T.StructType,
    keys: Sequence[str],
    vector: str,
    query_id: str,
    query_vector: str,
    width: int,
    cell_bytes: int = QUERY_BYTES,
    part: str | None = None,
    probes: str | None = None,
    decode=None,
) -> DataFrame:
    """Best rows per query and cell of a grid, for query sets of any size.

    Rows and queries fall into blocks by a hash of their keys. Every block of
    rows meets every block of queries in one cell; both blocks are sized to
    ``cell_bytes``, so a cell fits in a task whatever the two tables hold.
    With ``part`` and ``probes`` (a list of partitions per query) rows meet
    only the queries that look into their partition.
    """
    ship_package(table.sparkSession)
    keys = list(keys)
    row_bytes = width * 16 + search.k * 64
    blocks = max(1, math.ceil(2 * table.count() * row_bytes / cell_bytes))
    query_blocks = max(1, math.ceil(2 * queries.count() * row_bytes / cell_bytes))
    asked_columns = [F.col(query_id).alias("_id"), F.col(query_vector).alias("_vector")]
    row_columns = [*(F.col(key) for key in keys), F.col(vector).alias("_vector")]
    if part:
        asked_columns.append(F.col(probes).alias("_probes"))
        row_columns.append(F.col(part).alias("_part"))
    renamed = queries.select(*asked_columns)
    every_query_block = F.sequence(F.lit(0), F.lit(query_blocks - 1))
    every_block = F.sequence(F.lit(0), F.lit(blocks - 1))
    rows = table.select(
        *row_columns,
        F.pmod(F.xxhash64(*keys), F.lit(blocks)).cast("int").alias("_row_block"),
        F.explode(every_query_block).alias("_query_block"),
    )
    asked = renamed.select(
        "*",
        F.explode(every_block).alias("_row_block"),
        F.pmod(F.xxhash64("_id"), F.lit(query_blocks)).cast("int").alias("_query_block"),
    )

    empty = pa.table({f.name: pa.array([], _arrow(f.dataType)) for f in schema.fields})

    def compare(block: pa.Table, wanted: pa.Table) -> pa.Table:
        if not block.num_rows or not wanted.num_rows:
            return empty
        usable, vectors = vectors_of(wanted["_vector"], width)
        wanted = wanted.take(pa.array(usable)).combine_chunks()
        ids = pa.concat_arrays(wanted["_id"].chunks) if len(usable) else pa.array([], pa.int64())
        mask = None if part is None else probe_mask(wanted["_probes"].to_pylist())
        nearest = Nearest(QuerySet(ids, vectors, mask), search, keys)
        usable, vectors = vectors_of(block["_vector"], width)
        if decode is not None:
            vectors = decode.decode(vectors)
        selected = block.take(pa.array(usable))
        parts = None if part is None else selected["_part"].to_numpy()
        selected = selected.select(keys)
        for start in range(0, len(usable), 10_000):
            rows_here = slice(start, start + 10_000)
            nearest.add(
                selected.slice(start, 10_000),
                vectors[rows_here],
                None if parts is None else parts[rows_here],
            )
        found = nearest.result(query_id)
        return empty if found is None else found

    cell = ["_row_block", "_query_block"]
    return rows.groupBy(*cell).cogroup(asked.groupBy(*cell)).applyInArrow(compare, schema)


def probe_mask(probes: Sequence[Sequence[int]]) -> np.ndarray:
    """``mask[q, p]``: whether query ``q`` looks into partition ``p``."""
    mask = np.zeros((len(probes), 1 + max((max(p, default=0) for p in probes), default=0)), bool)
    for query, parts in enumerate(probes):
        mask[query, list(parts)] = True
    return mask


def _arrow(data_type: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(data_type)


def nearest(
    table: DataFrame,
    queries: DataFrame,
    k: int = NEIGHBOURS,
    *,
    key: str | Sequence[str] = "row_key",
    vector: str = "vector",
    query_id: str = "query_id",
    query_vector: str = "vector",
    metric: str = "cosine",
    min_distance: float | None = None,
    max_distance: float | None = None,
    dimension: int | None = None,
    max_query_bytes: int = QUERY_BYTES,
    cell_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """The ``k`` nearest rows of ``table`` for every query.

    Result: query id, key columns, ``_distance`` and ``rank`` from 1; ties go
    to the smaller key. Queries meet the rows of their own width; with
    ``dimension`` those of another width are left out, otherwise every width
    among the queries takes a scan of its own. Rows and queries with a null,
    incomplete or (cosine) zero vector have no distance and are left out.
    """
    keys = [key] if isinstance(key, str) else list(key)
    search = Search(k, metric, min_distance, max_distance)
    schema = _result_schema(table, queries, keys, query_id)
    few = few_queries(queries, query_id, query_vector, k, max_query_bytes) if dimension is None else None
    if few:
        parts = [scan_nearest(table, held, search, schema, keys, vector, query_id) for held in few]
        found = parts[0]
        for part in parts[1:]:
            found = found.union(part)
        return top_k(found, [query_id], [DISTANCE, *keys], k)
    widths = widths_of(queries, query_vector) if dimension is None else [dimension]
    found = table.sparkSession.createDataFrame([], schema)
    for number, width in enumerate(widths):
        asked = of_width(queries, query_vector, width)
        held = collect_queries(asked, query_id, query_vector, k, width, max_query_bytes)
        if held is None:
            best = grid_nearest(
                table, asked, search, schema, keys, vector, query_id, query_vector, width, cell_bytes
            )
        else:
            best = scan_nearest(table, held, search, schema, keys, vector, query_id)
        found = found.union(best) if number else best
    return top_k(found, [query_id], [DISTANCE, *keys], k)


def with_columns_of(
    found: DataFrame, table: DataFrame, key: str | Sequence[str], columns: Sequence[str], small: bool
) -> DataFrame:
    """Search results joined back to columns of the table.

    ``small``: the result was checked to be small enough for every task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    return join_same(table.select(*keys, *columns), found, keys, small)


def few_results(queries: DataFrame, k: int) -> bool:
    """Whether ``k`` rows for each query are few enough to send to every task."""
    return has_at_most(queries, BROADCAST_ROWS // k)
