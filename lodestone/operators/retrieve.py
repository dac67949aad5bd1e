"""Retrieval by whole table, nearest lines, whole files or whole chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import neighbours as nn
from lodestone.operators.embedding import Embedder, embed_column
from lodestone.operators.filters import checked_queries, row_cap, with_content
from lodestone.operators.ordering import top_k
from lodestone.schema import NEIGHBOURS
from lodestone.session import has_at_most, stored

# What identifies a line of the vector table, in reading order.
LINE_KEY = ("path", "chunk_number", "line_no")
# Lines of one file that meet their queries in one task.
LINES_PER_STRETCH = 65_536
MODES = ("nearest", "file", "chunk", "all")


def all_content(
    table: DataFrame, key: Sequence[str] = LINE_KEY, cap: int | None = None
) -> DataFrame:
    """Content of the whole table, without its vectors."""
    shown = with_content(table).select(*key, "metadata", "content")
    return row_cap(shown, key, cap)


def nearest_lines(
    table: DataFrame,
    queries: DataFrame,
    k: int = NEIGHBOURS,
    *,
    key: Sequence[str] = LINE_KEY,
    columns: Sequence[str] = ("metadata", "content"),
    prefilter: Column | None = None,
    postfilter: Column | None = None,
    search=nn.nearest,
    **options,
) -> DataFrame:
    """The nearest lines per query with some of their columns.

    ``postfilter`` applies after the ``k`` nearest are chosen, so fewer may
    remain; ``prefilter`` applies before. Without either, missing content is
    post-filtered.
    """
    if postfilter is None and prefilter is None and "content" in table.columns:
        postfilter = F.col("content").isNotNull()
    searched = table if prefilter is None else table.where(prefilter)
    found = search(searched, queries, k, key=list(key), **options)
    small = nn.few_results(queries, k)
    rest = [c for c in columns if c not in key]
    if postfilter is not None:
        table = table.where(postfilter)
    return nn.with_columns_of(found, table, key, rest, small)


def _lines_of(
    found: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    query_id: str,
    key: Sequence[str],
    cap: int | None,
    small: bool,
) -> DataFrame:
    """All lines that agree with a found line in ``on``, per query.

    Few results are sent to the lines, which do not move. Otherwise both sides
    meet by ``on`` and a stretch of it: lines fall into stretches by a hash of
    their keys, as many per value of ``on`` as its lines fill, and a query is
    repeated for those stretches alone. With ``cap`` only the first lines in
    reading order, with their ``rank``.
    """
    wanted = found.where(F.col(on[0]).isNotNull()).select(query_id, *on).distinct()
    columns = list(dict.fromkeys([*on, *key, "content"]))
    lines = with_content(table).select(*columns)
    if small:
        lines = lines.join(F.broadcast(wanted), list(on))
    else:
        wanted = stored(wanted, "wanted-files")
        sizes = stored(
            lines.join(wanted.select(*on).distinct(), list(on), "left_semi")
            .groupBy(*on)
            .agg((1 + F.floor(F.count(F.lit(1)) / LINES_PER_STRETCH)).cast("int").alias("_stretches")),
            "file-sizes",
        )
        every = F.explode(F.sequence(F.lit(0), F.col("_stretches") - 1)).alias("_stretch")
        wanted = wanted.join(sizes, list(on)).select(query_id, *on, every)
        # only values of several stretches, few by their size, need their number at the lines
        large = F.broadcast(sizes.where(F.col("_stretches") > 1)) if has_at_most(
            sizes.where(F.col("_stretches") > 1), nn.BROADCAST_ROWS
        ) else sizes.where(F.col("_stretches") > 1)
        stretch = F.pmod(F.xxhash64(*key), F.coalesce("_stretches", F.lit(1))).cast("int")
        lines = lines.join(large, list(on), "left").withColumn("_stretch", stretch).drop("_stretches")
        lines = lines.join(wanted, [*on, "_stretch"]).drop("_stretch")
    order = list(dict.fromkeys([*on, *key]))
    if cap is None:
        return lines
    return top_k(lines, [query_id], order, cap)


def file_context(
    table: DataFrame,
    queries: DataFrame,
    k: int = NEIGHBOURS,
    *,
    key: Sequence[str] = LINE_KEY,
    query_id: str = "query_id",
    file: str = "path",
    cap: int | None = None,
    **options,
) -> DataFrame:
    """All lines of every file that holds one of the nearest lines.

    Files are told apart by ``path``; ``file="metadata"`` takes all files of one
    base name together.
    """
    found = nearest_lines(
        table, queries, k, key=key, columns=(file,), query_id=query_id, **options
    )
    small = nn.few_results(queries, k)
    return _lines_of(found, table, [file], query_id, key, cap, small)


def chunk_context(
    table: DataFrame,
    queries: DataFrame,
    k: int = NEIGHBOURS,
    *,
    key: Sequence[str] = LINE_KEY,
    query_id: str = "query_id",
    chunk: Sequence[str] = ("path", "chunk_number"),
    cap: int | None = None,
    **options,
) -> DataFrame:
    """All lines of every chunk that holds one of the nearest lines."""
    found = nearest_lines(
        table, queries, k, key=key, columns=chunk, query_id=query_id, **options
    )
    small = nn.few_results(queries, k)
    return _lines_of(found, table, list(chunk), query_id, key, cap, small)


def context_string(
    found: DataFrame,
    query_id: str = "query_id",
    order: Sequence[str] = ("rank",),
    content: str = "content",
    name: str = "context",
    separator: str = " ",
) -> DataFrame:
    """The contents of each query as one text, in order."""
    ordered = F.sort_array(F.collect_list(F.struct(*order, content)))
    joined = F.array_join(F.transform(ordered, lambda x: x[content]), separator)
    return found.groupBy(query_id).agg(joined.alias(name))


def retrieve(
    table: DataFrame,
    queries: DataFrame,
    mode: str = "nearest",
    k: int = NEIGHBOURS,
    cap: int | None = None,
    **options,
) -> DataFrame:
    """Content for each query vector in one of four modes.

    Mode ``all`` needs no vectors: it returns the table once, without query
    ids, and the queries are never embedded.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "all":
        return all_content(table, options.get("key", LINE_KEY), cap)
    if mode == "nearest":
        return nearest_lines(table, queries, k, **options)
    context = file_context if mode == "file" else chunk_context
    return context(table, queries, k, cap=cap, **options)


def query_vectors(
    queries: DataFrame, embedder: Embedder, text: str = "text", vector: str = "vector"
) -> DataFrame:
    """Queries with text and their vectors; empty texts are left out."""
    return embed_column(checked_queries(queries, text), text, embedder, vector)
