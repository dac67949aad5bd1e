"""Packing of long rows of units into overlapping chunks, spread over slices.

Where a chunk starts decides where the next one starts, so the chunks of a file
form a chain from its first unit to its end. A file is cut into slices by
character offset. With a little of what lies around it, a slice finds for every
place at which the chain may enter it where the chain leaves and how many chunks
start inside. These tables, some dozens of rows each, are composed from slice to
slice, in groups and groups of groups for files of any length; after that every
slice knows its first chunk and cuts its own. The chunks are those of
``chunks.pack`` over the whole file.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lodestone.functions.text import trim_space
from lodestone.operators.joins import join_same
from lodestone.session import ship_package, stored

#: Characters of a slice, or as many as hold several chunks.
SLICE_CHARS = 1 << 20
#: Slices whose tables are composed in one step.
GROUP = 256
#: Where a chain is when its file has ended.
END = -1


class Slice:
    """The units of one slice and its surroundings, from pieces ``(start, length, opens, blank)``.

    Pieces between two that open a block are one unit if they fit in ``cap``
    together; otherwise, and where nothing says what opens a block, each piece
    is a unit.
    """

    def __init__(self, pieces: pa.Table, number: int, width: int, cap: int, overlap: int):
        start = pieces.column("_start").to_numpy().astype(np.int64)
        length = pieces.column("_length").to_numpy().astype(np.int64)
        order = np.argsort(start)
        self.order, start, length = order, start[order], length[order]
        opens = pieces.column("_opens").to_pylist()
        past = int(start[-1] + length[-1])
        heads = np.ones(len(start), bool)
        if opens[0] is not None:
            opening = np.array(opens, bool)[order] | (start == 0)
            first = np.flatnonzero(opening)
            sizes = np.diff(np.append(start[first], past))
            block = np.cumsum(opening) - 1
            joined = (block >= 0) & (sizes[block] <= cap) if len(first) else np.zeros(len(start), bool)
            heads = ~joined | opening
        self.piece = np.append(np.flatnonzero(heads), len(start))
        self.bounds = np.append(start[heads], past)
        blank = pieces.column("_blank").to_numpy(zero_copy_only=False)[order]
        worded = np.concatenate([[0], np.cumsum(~blank)])
        begin, end = number * width, (number + 1) * width
        self.own = np.flatnonzero((self.bounds[:-1] >= begin) & (self.bounds[:-1] < end))
        bounds = self.bounds
        self.past = np.searchsorted(bounds, bounds[self.own] + cap, side="right") - 1
        last = self.past == len(bounds) - 1
        behind = np.minimum(self.past, len(bounds) - 2)
        room = np.minimum(overlap, cap - (bounds[behind + 1] - bounds[behind]))
        back = np.searchsorted(bounds, bounds[behind] - room, side="left")
        self.next = np.where(last, END, np.maximum(self.own + 1, back))
        self.filled = worded[self.piece[self.past]] > worded[self.piece[self.own]]

    def table(self, entries: int) -> list[tuple[int, int, int]]:
        """``(entry, exit, chunks)`` for all units that start below ``entries``, the only one of the file's first slice."""
        n, low = len(self.own), int(self.own[0]) if len(self.own) else 0
        leaves, chunks = [END] * n, [0] * n
        bounds = self.bounds
        for k, (then, filled) in zip(range(n - 1, -1, -1), zip(self.next[::-1].tolist(), self.filled[::-1].tolist())):
            inside = then - low
            if then != END and inside < n:
                leaves[k], chunks[k] = leaves[inside], chunks[inside] + filled
            else:
                leaves[k], chunks[k] = (END if then == END else int(bounds[then])), int(filled)
        starts = bounds[self.own]
        wanted = int(np.searchsorted(starts, entries))
        return [(int(starts[k]), leaves[k], chunks[k]) for k in range(wanted)]

    def chunks(self, entry: int) -> list[tuple[int, int]]:
        """First and past piece of every chunk with words that starts here, when the chain enters at ``entry``."""
        found = []
        low, n = int(self.own[0]), len(self.own)
        k = int(np.searchsorted(self.bounds[self.own], entry))
        while k < n:
            if self.filled[k]:
                found.append((int(self.piece[self.own[k]]), int(self.piece[self.past[k]])))
            if self.next[k] == END:
                break
            k = int(self.next[k]) - low
        return found


def _walk(table: pa.Table, entry: int, steps: list | None = None) -> tuple[int, int]:
    """Where a chain that enters at ``entry`` is after the slices of ``table``, and its chunks; notes each entry in ``steps``."""
    return _walk_all(_by_slice(table), entry, steps)


def _by_slice(table: pa.Table) -> list[tuple[int, dict[int, tuple[int, int]]]]:
    slices: dict[int, dict[int, tuple[int, int]]] = {}
    columns = [table.column(name).to_pylist() for name in ("_slice", "_entry", "_exit", "_chunks")]
    for number, entry, leaves, chunks in zip(*columns):
        slices.setdefault(number, {})[entry] = (leaves, chunks)
    return sorted(slices.items())


def _walk_all(slices, entry: int, steps: list | None = None) -> tuple[int, int]:
    chunks = 0
    for number, ways in slices:
        if entry == END:
            break
        # a chain may pass over a file's short last slice
        if entry in ways:
            if steps is not None:
                steps.append((number, entry, chunks))
            entry, more = ways[entry]
            chunks += more
    return entry, chunks


def _columns(like: pa.Table, keys: Sequence[str], rows: int) -> list[pa.Array]:
    """The values of ``keys``, the same in all rows of a group, ``rows`` times."""
    return [pa.concat_arrays([like.column(k).chunk(0).slice(0, 1)] * rows) if rows else like.column(k).chunk(0).slice(0, 0) for k in keys]


def _entries(tables: DataFrame, file: str) -> DataFrame:
    """Per slice that a chain enters: the file, ``_slice``, ``_entry``, ``_number`` of chunks before it."""
    key = tables.schema[file]
    schema = T.StructType([key]).add("_slice", "long").add("_entry", "long").add("_number", "long")

    def laid(table: pa.Table, entry: int, before: int) -> pa.Table:
        steps: list[tuple[int, int, int]] = []
        _walk(table, entry, steps)
        columns = _columns(table, [file], len(steps))
        columns += [pa.array([s[k] + (before if k == 2 else 0) for s in steps], pa.int64()) for k in range(3)]
        return pa.Table.from_arrays(columns, schema.names)

    last = tables.agg(F.max("_slice")).first()[0]
    if last is None or last < GROUP:
        return tables.groupBy(file).applyInArrow(lambda table: laid(table, 0, 0), schema)

    grouped = tables.withColumn("_group", F.floor(F.col("_slice") / GROUP))
    composed = T.StructType([key]).add("_slice", "long").add("_entry", "long").add("_exit", "long").add("_chunks", "long")

    def compose(table: pa.Table) -> pa.Table:
        slices = _by_slice(table)
        ways = [(entry, *_walk_all(slices, entry)) for entry in slices[0][1]]
        columns = _columns(table, [file, "_group"], len(ways))
        columns += [pa.array([w[k] for w in ways], pa.int64()) for k in range(3)]
        return pa.Table.from_arrays(columns, composed.names)

    upper = stored(grouped.groupBy(file, "_group").applyInArrow(compose, composed), "chunk-groups")
    above = _entries(upper, file).select(
        file, F.col("_slice").alias("_group"), F.col("_entry").alias("_from"), F.col("_number").alias("_before")
    )

    def inside(table: pa.Table) -> pa.Table:
        return laid(table, table.column("_from")[0].as_py(), table.column("_before")[0].as_py())

    return join_same(grouped, above, [file, "_group"]).groupBy(file, "_group").applyInArrow(inside, schema)


def pack_pieces(
    pieces: DataFrame, file: str, keep: Sequence[str], cap: int, overlap: int, slice_chars: int | None = None
) -> DataFrame:
    """Chunks of files of any size: ``file``, ``keep``, ``chunk_number`` from 0, ``chunk``.

    ``pieces`` hold ``file``, ``keep`` (the same in all rows of a file),
    ``_start`` (character offset in the file), ``_piece`` (text, none longer than
    ``cap``; the pieces of a file tile it), its ``_length``, ``_opens`` (whether it
    begins a block; null in files without blocks) and ``_blank`` (whether it has no
    word). Chunks lose their outer white space, blank ones are left out. Pieces are
    read twice, so they should be stored.
    """
    spark = pieces.sparkSession
    ship_package(spark)
    width = max(slice_chars or SLICE_CHARS, 8 * cap)
    number = F.floor(F.col("_start") / width)
    inside = F.col("_start") - number * width
    near = [
        F.when((number > 0) & (inside < 4 * cap), number - 1),
        F.when(width - inside <= 2 * cap, number + 1),
    ]
    held = pieces.select(
        file,
        *keep,
        "_start",
        "_piece",
        "_length",
        F.col("_opens").cast("boolean").alias("_opens"),
        "_blank",
        F.explode(F.array_compact(F.array(number, *near))).alias("_slice"),
    )
    key = held.schema[file]
    tables_type = T.StructType([key]).add("_slice", "long").add("_entry", "long").add("_exit", "long").add("_chunks", "long")

    def ways(table: pa.Table) -> pa.Table:
        here = table.column("_slice")[0].as_py()
        rows = Slice(table, here, width, cap, overlap).table(here * width + cap if here else 1)
        columns = _columns(table, [file, "_slice"], len(rows))
        columns += [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
        return pa.Table.from_arrays(columns, tables_type.names)

    # a file of one slice is entered at its start; only longer ones need ways through their slices
    files = stored(held.groupBy(file).agg(F.max("_slice").alias("_last")), "chunk-files")
    zero = F.lit(0).cast("long")
    short = files.where("_last = 0").select(file, zero.alias("_slice"), zero.alias("_entry"), zero.alias("_number"))
    sizes = held.select(file, "_slice", "_start", "_length", "_opens", "_blank")
    sizes = join_same(sizes, files.where("_last > 0").select(file), [file], how="left_semi")
    tables = stored(sizes.groupBy(file, "_slice").applyInArrow(ways, tables_type), "chunk-ways")
    entries = short.unionByName(_entries(tables, file))
    kept = [held.schema[c] for c in (file, *keep)]
    chunks_type = T.StructType(kept).add("chunk_number", "integer").add("chunk", "string")

    def cut(table: pa.Table, entered: pa.Table) -> pa.Table:
        if not table.num_rows or not entered.num_rows:
            return nothing
        own = Slice(table, table.column("_slice")[0].as_py(), width, cap, overlap)
        texts = table.column("_piece").to_pylist()
        texts = [texts[k] for k in own.order.tolist()]
        spans = own.chunks(entered.column("_entry")[0].as_py())
        before = entered.column("_number")[0].as_py()
        columns = _columns(table, [file, *keep], len(spans))
        columns.append(pa.array(range(before, before + len(spans)), pa.int32()))
        columns.append(pa.array(["".join(texts[a:b]) for a, b in spans], pa.string()))
        return pa.Table.from_arrays(columns, chunks_type.names)

    # a slice and the place at which it is entered come together by their key, without a join before
    here = [file, "_slice"]
    nothing = to_arrow_schema(chunks_type).empty_table()
    texts = held.select(file, *keep, "_start", "_length", "_opens", "_blank", "_piece", "_slice")
    found = texts.groupBy(*here).cogroup(entries.groupBy(*here)).applyInArrow(cut, chunks_type)
    return found.withColumn("chunk", trim_space(F.col("chunk")))
