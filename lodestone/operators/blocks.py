"""Postings clustered by term, in blocks, and ranking that expands few of them.

A block holds up to some hundred postings of one term in row order: gaps between
row numbers, counts, row lengths and positions, each number in as many bytes as
it needs. Beside them stand the first and last row and the two figures that
bound every score in the block. These columns are the directory; a search reads
it for the terms asked, and expands only blocks whose rows may still reach the
best ``k``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators.joins import join_same
from lodestone.operators.ordering import numbered, running_offsets, top_k
from lodestone.operators.postings import B, K1, QUERY_TERMS, query_terms, terms
from lodestone.session import has_at_most, ship_package, stored

#: Buckets of terms, the folders of a stored index.
BUCKETS = 64
#: Postings of a block.
BLOCK = 256
#: Rows that one task numbers at a time.
NUMBERED_ROWS = 1 << 20
#: Terms of which a task makes blocks at a time.
PIECE_TERMS = 1 << 21
#: Bytes of text whose postings one task puts into blocks.
BLOCKED_BYTES = 32 << 20
#: Row numbers that meet by equality when rows look for the blocks that hold them.
SPAN = 1 << 16
#: Terms in the texts of a stretch of rows whose scores one task adds up at a time.
SPAN_POSTINGS = 1 << 22
#: Rows whose keys a task holds at a time while postings get them.
KEYED_ROWS = 1 << 12
#: Postings of a batch that gets keys.
KEYED_POSTINGS = 1 << 18
#: Postings, for each row asked for, that are expanded first to learn what score a row needs.
SEEDS = 4
#: Rows that are sent to every task to be joined there.
SENT_ROWS = 200_000
#: Scores are compared with this slack, as sums differ in their last digits with their order.
SLACK = 1e-9
DIRECTORY = ("bucket", "term", "first", "last", "n", "max_tf", "least_terms")
BLOCKS = (
    "bucket int, term string, first long, last long, n int, total_tf long, max_tf long, least_terms int, "
    "rows binary, tfs binary, sizes binary, places binary"
)
UNDEALT = BLOCKS.removeprefix("bucket int, ")


def packed_numbers(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers from 0 as bytes of seven bits, the last of a number below 128; and how many bytes each takes."""
    values = values.astype(np.uint64)
    sizes = np.ones(len(values), np.int64)
    large = np.flatnonzero(values >= 128)
    if not len(large):
        return values.astype(np.uint8), sizes
    # most numbers take one byte; only the others are looked at again
    kept = values[large]
    more = np.ones(len(large), np.int64)
    for k in range(1, 10):
        if int(kept.max()) >> 7 * k:
            more += kept >= np.uint64(1) << np.uint64(7 * k)
    sizes[large] = more
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    out[starts] = values.astype(np.uint8) & 127
    place = starts[large]
    for k in range(1, int(more.max())):
        out[place + k - 1] |= 128
        out[place + k] = (kept >> np.uint64(7 * k)).astype(np.uint8) & 127
        here = more > k + 1
        place, kept, more = place[here], kept[here], more[here]
    return out, sizes


def unpacked_numbers(data: np.ndarray) -> np.ndarray:
    """The numbers of ``packed_numbers``."""
    if not len(data):
        return np.zeros(0, np.int64)
    last = np.flatnonzero(data < 128)
    if len(last) == len(data):
        return data.astype(np.int64)
    starts = np.concatenate([[0], last[:-1] + 1])
    out = (data[starts] & 127).astype(np.int64)
    large = np.flatnonzero(last > starts)
    for k in range(1, 10):
        out[large] |= (data[starts[large] + k] & 127).astype(np.int64) << 7 * k
        large = large[last[large] - starts[large] > k]
        if not len(large):
            break
    return out


def _binary(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    offsets = bounds.astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def numbered_rows(table: DataFrame, key: Sequence[str], first: int = 0) -> DataFrame:
    """``key`` and ``row_no`` from ``first``, without gaps."""
    slices = 1 + table.count() // NUMBERED_ROWS
    here = F.pmod(F.xxhash64(*key), F.lit(slices))
    rows = table.select(*key).withColumn("_all", F.lit(0))
    return numbered(rows, ["_all"], list(key), here, "row_no").select(
        *key, (F.col("row_no") + first).alias("row_no")
    )


def placed_rows(table: DataFrame, first: int = 0) -> DataFrame:
    """``table``, stored, with ``row_no`` from ``first``, without gaps; no row is shuffled."""
    rows = stored(table.withColumn("_place", F.monotonically_increasing_id()), "placed")
    task = F.shiftright("_place", 33)
    starts = running_offsets(rows.withColumn("_all", F.lit(0)), ["_all"], task, F.lit(1)).drop("_all")
    here = rows.withColumn("_slice", task)
    number = F.col("_before") + F.col("_place").bitwiseAND((1 << 33) - 1) + first
    # one row for each task that wrote
    placed = here.join(F.broadcast(starts), "_slice").withColumn("row_no", number.cast("long"))
    return placed.drop("_slice", "_before", "_place")


def text_rows(table: DataFrame, rows: DataFrame, text: str, key: Sequence[str]) -> DataFrame:
    """``row_no`` and ``text`` of the rows that have one."""
    shown = table.where(F.col(text).isNotNull()).select(*key, F.col(text).alias("text"))
    return join_same(shown, rows, list(key)).select("row_no", "text")


def _starts(code: np.ndarray, block: int) -> np.ndarray:
    """Where a block starts, of postings in the order of their term's ``code``."""
    heads = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    since = np.arange(len(code)) - np.repeat(heads, np.diff(np.append(heads, len(code))))
    return np.flatnonzero(since % block == 0)


def _gaps(row: np.ndarray, starts: np.ndarray) -> np.ndarray:
    gaps = np.diff(row, prepend=0)
    gaps[starts] = 0
    return gaps


def _laid(n: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, ...]:
    """Where the gaps, counts, lengths and steps of pieces of ``n`` postings lie among all their numbers."""
    first = np.cumsum(3 * n + steps) - (3 * n + steps)
    gaps = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    more = np.repeat(n, n)
    last = np.repeat(first + 3 * n - (np.cumsum(steps) - steps), steps) + np.arange(steps.sum())
    return gaps, gaps + more, gaps + 2 * more, last


def _stretches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows ``row_no`` and their terms, in order, of some million terms at a time."""
    held, count = [], 0
    for batch in batches:
        ends = batch.column(1).offsets.to_numpy().astype(np.int64)
        first = 0
        while first < batch.num_rows:
            room = max(PIECE_TERMS - count, 1)
            past = max(first + 1, int(np.searchsorted(ends, ends[first] + room, "right")) - 1)
            held.append(batch.slice(first, past - first))
            count += int(ends[past] - ends[first])
            first = past
            if first < batch.num_rows or count >= PIECE_TERMS:
                yield pa.Table.from_batches(held)
                held, count = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _pieces(batches: Iterable[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """The postings of rows ``row_no`` and their terms, up to ``block`` of a term and a stretch of rows together."""
    for table in _stretches(batches):
        row = table.column(0).to_numpy()
        if (row[1:] < row[:-1]).any():
            table = table.take(pc.array_sort_indices(table.column(0)))
            row = table.column(0).to_numpy()
        sizes = pc.list_value_length(table.column(1)).to_numpy().astype(np.int64)
        coded = pc.list_flatten(table.column(1)).combine_chunks().dictionary_encode()
        if not len(coded):
            continue
        # by code and place: one sort of numbers is faster than a stable one of places
        order = coded.indices.to_numpy().astype(np.int64) << 32
        order |= np.arange(len(order))
        order.sort()
        codes = (order >> 32).astype(np.int32)
        order &= (1 << 32) - 1
        of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
        at = order - (np.cumsum(sizes) - sizes)[of]
        heads = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (of[1:] != of[:-1])]))
        steps = np.diff(at, prepend=0)
        steps[heads] = at[heads]
        tf, of, codes = np.diff(np.append(heads, len(codes))), of[heads], codes[heads]
        row, starts = row[of], _starts(codes, block)
        n = np.diff(np.append(starts, len(codes)))
        many = np.add.reduceat(tf, starts)
        numbers = np.empty(int((3 * n + many).sum()), np.int64)
        for place, values in zip(_laid(n, many), (_gaps(row, starts), tf, sizes[of], steps)):
            numbers[place] = values
        data, widths = packed_numbers(numbers)
        ends = np.concatenate([[0], np.cumsum(widths)])[np.concatenate([[0], np.cumsum(3 * n + many)])]
        columns = [coded.dictionary.take(pa.array(codes[starts])), pa.array(row[starts]), pa.array(n.astype(np.int32))]
        yield pa.RecordBatch.from_arrays([*columns, _binary(data, ends)], ["term", "first", "n", "data"])


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column and where each value ends."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    held = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return held, ends[1:] - ends[0]


def _numbers(column: pa.Array) -> np.ndarray:
    """All numbers of a column of ``packed_numbers``."""
    return unpacked_numbers(_bytes(column)[0])


def _rows_of(first: np.ndarray, n: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """Row numbers of blocks from their gaps."""
    total = np.cumsum(gaps)
    return np.repeat(first - total[np.cumsum(n) - n], n) + total


def _merged(batches: Iterable[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Blocks from the pieces of terms."""
    for batch in batches:
        if not batch.num_rows:
            continue
        term, first, n, data = batch.columns
        coded, n = term.dictionary_encode(), n.to_numpy().astype(np.int64)
        held, ends = _bytes(data)
        numbers, upto = unpacked_numbers(held), np.cumsum(held < 128)[ends - 1]
        gaps, tf, size, steps = (numbers[place] for place in _laid(n, np.diff(upto, prepend=0) - 3 * n))
        code, row = np.repeat(coded.indices.to_numpy(), n), _rows_of(first.to_numpy(), n, gaps)
        if ((code[1:] == code[:-1]) & (row[1:] < row[:-1])).any():
            order = np.lexsort((row, code))
            begins = (np.cumsum(tf) - tf)[order]
            code, row, tf, size = code[order], row[order], tf[order], size[order]
            steps = steps[np.repeat(begins - (np.cumsum(tf) - tf), tf) + np.arange(len(steps))]
        starts = _starts(code, block)
        bounds, places = np.append(starts, len(row)), np.concatenate([[0], np.cumsum(tf)])
        columns = [coded.dictionary.take(pa.array(code[starts])), pa.array(row[starts]), pa.array(row[bounds[1:] - 1])]
        columns += [pa.array(np.diff(bounds).astype(np.int32)), pa.array(np.add.reduceat(tf, starts))]
        columns += [pa.array(np.maximum.reduceat(tf, starts)), pa.array(np.minimum.reduceat(size, starts).astype(np.int32))]
        for values, cut in ((_gaps(row, starts), bounds), (tf, bounds), (size, bounds), (steps, places[bounds])):
            packed, sizes = packed_numbers(values)
            columns.append(_binary(packed, np.concatenate([[0], np.cumsum(sizes)])[cut]))
        yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in UNDEALT.split(", ")])


def blocks_of(texts: DataFrame, tasks: int | None = None, block: int = BLOCK) -> DataFrame:
    """The blocks of ``texts`` (``row_no, text``).

    A task puts together the postings of its own rows; only these pieces, some
    bytes per posting, are shuffled. Pieces as large as a block are dealt by their
    row as well as their term, so that a term of a third of all postings lies in
    as many tasks as its share asks for. A task sorts the pieces of so many bytes
    of text, whatever the size of the table and however well the pieces compress.
    """
    spark = texts.sparkSession
    ship_package(spark)
    if tasks is None:
        size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        tasks = max(spark.sparkContext.defaultParallelism, 1 + size // BLOCKED_BYTES)
    split = texts.where(F.col("text").isNotNull()).select(F.col("row_no").cast("long"), terms(F.col("text")).alias("_terms"))
    made = split.mapInArrow(lambda batches: _pieces(batches, block), "term string, first long, n int, data binary")
    slices = 1 + 16 * tasks // BUCKETS
    near = F.when(F.col("n") >= block, F.floor(F.col("first") / SPAN))
    dealt = made.select(
        F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("bucket"),
        F.pmod(F.xxhash64("term", near), F.lit(slices)).alias("_slice"),
        "*",
    )
    # slices of a bucket follow each other, so that a task writes to few buckets
    task = F.floor((F.col("bucket") * slices + F.col("_slice")) * tasks / (BUCKETS * slices)).cast("int")
    dealt = dealt.repartitionById(tasks, task).drop("bucket", "_slice")
    dealt = dealt.sortWithinPartitions("term", "first")
    merged = dealt.mapInArrow(lambda batches: _merged(batches, block), UNDEALT)
    return merged.select(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("bucket"), "*")


def _expand(batches: Iterable[pa.RecordBatch], places: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        first, n = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        numbers = [_numbers(batch.column(k)) for k in range(3, batch.num_columns)]
        of = np.repeat(np.arange(len(n)), n)
        row = _rows_of(first, n, numbers[0])
        columns = [batch.column(0).take(pa.array(of)), pa.array(first[of]), pa.array(row), pa.array(numbers[1])]
        columns.append(pa.array(numbers[2].astype(np.int32)))
        names = ["term", "first", "row_no", "tf", "row_terms"]
        if places:
            tf, steps = numbers[1], numbers[3]
            sums = np.cumsum(steps)
            heads = np.cumsum(tf) - tf
            at = sums - np.repeat(sums[heads] - steps[heads], tf)
            cut = np.append(heads, len(steps)).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(cut), pa.array(at.astype(np.int32))))
            names.append("positions")
        yield pa.RecordBatch.from_arrays(columns, names)


def expanded(blocks: DataFrame, places: bool = False) -> DataFrame:
    """The postings of blocks: ``term, first`` (of the block), ``row_no, tf, row_terms`` and, if asked for, ``positions``."""
    ship_package(blocks.sparkSession)
    names = ["term", "first", "n", "rows", "tfs", "sizes", *(["places"] if places else [])]
    schema = "term string, first long, row_no long, tf long, row_terms int" + (", positions array<int>" if places else "")
    return blocks.select(*names).mapInArrow(lambda batches: _expand(batches, places), schema)


def _cut(batches: Iterable[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """Blocks in pieces, each of one stretch of ``span`` rows; rows are counted from its first."""
    for batch in batches:
        if not batch.num_rows:
            continue
        n = batch.column(2).to_numpy().astype(np.int64)
        gaps, tf, size, steps = (_numbers(batch.column(k)) for k in range(3, 7))
        row = _rows_of(batch.column(1).to_numpy(), n, gaps)
        of, at = np.repeat(np.arange(len(n)), n), row // span
        starts = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (at[1:] != at[:-1])]))
        bounds, places = np.append(starts, len(row)), np.concatenate([[0], np.cumsum(tf)])
        gaps = _gaps(row, starts)
        gaps[starts] = row[starts] - at[starts] * span
        columns = [pa.array(at[starts]), batch.column(0).take(pa.array(of[starts])), pa.array(np.diff(bounds).astype(np.int32))]
        for values, cut in ((gaps, bounds), (tf, bounds), (size, bounds), (steps, places[bounds])):
            packed, sizes = packed_numbers(values)
            columns.append(_binary(packed, np.concatenate([[0], np.cumsum(sizes)])[cut]))
        yield pa.RecordBatch.from_arrays(columns, ["span", "term", "n", "rows", "tfs", "sizes", "places"])


def _with_keys(batches: Iterable[pa.RecordBatch], keys: Sequence[str], span: int) -> Iterator[pa.RecordBatch]:
    """Postings with the keys of their rows; of every stretch the keys come first, then its pieces."""
    at, held, numbers, ordered = None, [], None, None
    for batch in batches:
        spans, named = batch.column("span").to_numpy(), batch.column("n").is_null().to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate([[True], (spans[1:] != spans[:-1]) | (named[1:] != named[:-1])]))
        for first, past in zip(starts, np.append(starts[1:], len(spans))):
            if spans[first] != at:
                at, held, numbers = spans[first], [], None
            if named[first]:
                held.append(batch.slice(first, past - first).select(["row_no", *keys]))
                continue
            if not held:
                continue
            if numbers is None:
                ordered = pa.Table.from_batches(held).sort_by("row_no").combine_chunks()
                numbers = ordered.column("row_no").to_numpy()
            ends = np.cumsum(batch.column("n").slice(first, past - first).to_numpy(zero_copy_only=False))
            while first < past:
                many = max(1, int(np.searchsorted(ends, KEYED_POSTINGS, "right")))
                part = batch.slice(first, min(many, past - first))
                # the gap before a piece's first row is its place in the stretch
                n = part.column("n").to_numpy().astype(np.int64)
                begin = at * span + _numbers(part.column("rows"))[np.cumsum(n) - n]
                pieces = [part.column("term"), pa.array(begin), part.column("n")]
                pieces += [part.column(name) for name in ("rows", "tfs", "sizes", "places")]
                names = ["term", "first", "n", "rows", "tfs", "sizes", "places"]
                for made in _expand([pa.RecordBatch.from_arrays(pieces, names)], True):
                    row = made.column("row_no").to_numpy()
                    place = np.minimum(np.searchsorted(numbers, row), len(numbers) - 1)
                    known = numbers[place] == row
                    columns = [ordered.column(key).chunk(0).take(pa.array(place)) for key in keys]
                    columns += [made.column(name) for name in ("term", "tf", "row_terms", "positions")]
                    made = pa.RecordBatch.from_arrays(columns, [*keys, "term", "tf", "row_terms", "positions"])
                    yield made if known.all() else made.filter(pa.array(known))
                ends = ends[part.num_rows :] - ends[part.num_rows - 1]
                first += part.num_rows


def keyed_postings(blocks: DataFrame, rows: DataFrame, key: Sequence[str], span: int = KEYED_ROWS) -> DataFrame:
    """The postings of blocks by the ``key`` of their rows: ``key, term, tf, row_terms, positions``.

    ``rows`` hold ``key`` and ``row_no``, which is never null. Pieces of blocks meet the keys of
    their stretch of rows; postings are expanded there and not shuffled.
    """
    spark = blocks.sparkSession
    ship_package(spark)
    names = ["term", "first", "n", "rows", "tfs", "sizes", "places"]
    schema = "span long, term string, n int, rows binary, tfs binary, sizes binary, places binary"
    pieces = blocks.select(*names).mapInArrow(lambda batches: _cut(batches, span), schema)
    named = rows.select(F.floor(F.col("row_no") / span).alias("span"), "row_no", *key)
    last = rows.agg(F.max("row_no") - F.min("row_no")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, 1 + last // span)
    met = named.unionByName(pieces, allowMissingColumns=True).repartition(tasks, "span")
    met = met.sortWithinPartitions("span", F.col("n").isNotNull())
    made = T.StructType([rows.schema[name] for name in key]).add("term", "string").add("tf", "long")
    made = made.add("row_terms", "integer").add("positions", T.ArrayType(T.IntegerType()))
    return met.mapInArrow(lambda batches: _with_keys(batches, key, span), made)


def block_stats(blocks: DataFrame) -> DataFrame:
    """Rows and occurrences per term, from the directory alone."""
    return blocks.groupBy("term").agg(
        F.sum("n").cast("long").alias("row_count"), F.sum("total_tf").alias("occurrences")
    )


def text_totals(texts: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row: ``rows`` with a text and ``terms``, all their terms. Rows of several loads add up."""
    terms = blocks.agg(F.coalesce(F.sum("total_tf"), F.lit(0)).alias("terms"))
    rows = texts.agg(F.count(F.lit(1)).alias("rows")).scalar()
    return terms.select(rows.alias("rows"), "terms")


def gain(tf: Column, terms: Column, mean: Column) -> Column:
    """What a term adds to a row's score, before its weight: grows with ``tf``, falls with the row's ``terms``."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * terms / mean))


def _sums(blocks: DataFrame, strong: DataFrame, mean: float | None, k: int, query_id: str) -> DataFrame:
    """``query_id, row_no, score``: sums over the strong terms, of all rows that may be among the best ``k``.

    Postings of the terms, not their sums by query, are shuffled, by stretches of
    rows. A task has the postings of one stretch at a time and adds them up query
    by query; what cannot be among the best of its stretch stays there.
    ``strong`` are as many terms of queries as a task may hold.
    """
    asked = strong.where(F.col(query_id).isNotNull()).collect()
    code = {term: c for c, term in enumerate(sorted({r.term for r in asked}))}
    number: dict = {}
    need, queries = np.full(len(code), np.inf), []
    for r in asked:
        if r[query_id] not in number:
            number[r[query_id]] = len(number)
            queries.append((r.least, r.weak_top, []))
        queries[number[r[query_id]]][2].append((code[r.term], r.idf))
        least = (r.least - r.all_top + r.top) / r.idf
        need[code[r.term]] = min(need[code[r.term]], least - SLACK * abs(least))
    # a stretch of rows has some millions of postings, whatever the length of its texts
    span = max(1 << 8, min(SPAN, 1 << int(np.log2(SPAN_POSTINGS / max(mean or 1, 1)))))

    def gains(tf: np.ndarray, size: np.ndarray) -> np.ndarray:
        return tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))

    def dealt(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column("term").dictionary_encode()
            codes = np.array([code.get(t, -1) for t in coded.dictionary.to_pylist()], np.int32)[coded.indices.to_numpy()]
            bounds = gains(batch.column("max_tf").to_numpy(), batch.column("least_terms").to_numpy())
            here = (codes >= 0) & (bounds >= need[codes])
            if not here.any():
                continue
            batch, codes = batch.filter(pa.array(here)), codes[here]
            n = batch.column("n").to_numpy()
            gaps, tf, size = (_numbers(batch.column(name)) for name in ("rows", "tfs", "sizes"))
            row = _rows_of(batch.column("first").to_numpy(), n, gaps)
            of, at = np.repeat(np.arange(len(n)), n), row // span
            starts = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (at[1:] != at[:-1])]))
            bounds = np.append(starts, len(row))
            columns = [pa.array(at[starts]), pa.array(codes[of[starts]]), pa.array(np.diff(bounds).astype(np.int32))]
            steps = np.diff(row, prepend=0)
            steps[starts] = row[starts] - at[starts] * span
            for values in (steps, tf, size):
                data, sizes = packed_numbers(values)
                columns.append(_binary(data, np.concatenate([[0], np.cumsum(sizes)])[bounds]))
            yield pa.RecordBatch.from_arrays(columns, ["span", "code", "n", "rows", "tfs", "sizes"])

    def best(at: int, held: list[tuple]) -> pa.RecordBatch:
        codes, rows, values = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(codes, kind="stable")
        codes, rows, values = codes[order], rows[order], values[order]
        cuts = np.searchsorted(codes, np.arange(len(code) + 1))
        found: list[tuple] = []
        for q, (least, weak, terms_) in enumerate(queries):
            total = np.zeros(span)
            for c, idf in terms_:
                total[rows[cuts[c] : cuts[c + 1]]] += idf * values[cuts[c] : cuts[c + 1]]
            named = np.flatnonzero(total)
            score = total[named]
            if len(score) > k:
                least = max(least, np.partition(score, len(score) - k)[len(score) - k] * (1 - SLACK))
            kept = score + weak >= least
            found.append((np.full(int(kept.sum()), q, np.int32), named[kept] + at * span, score[kept]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["_q", "row_no", "score"])

    def added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            spans, n = batch.column("span").to_numpy(), batch.column("n").to_numpy()
            steps, tf, size = (_numbers(batch.column(name)) for name in ("rows", "tfs", "sizes"))
            row, value = _rows_of(np.zeros(len(n), np.int64), n, steps), gains(tf, size)
            row += np.repeat(steps[np.cumsum(n) - n], n)
            codes, ends = np.repeat(batch.column("code").to_numpy(), n), np.concatenate([[0], np.cumsum(n)])
            starts = np.flatnonzero(np.concatenate([[True], spans[1:] != spans[:-1]]))
            for first, past in zip(starts, np.append(starts[1:], len(spans))):
                if held and spans[first] != at:
                    yield best(at, held)
                    held = []
                at, cut = int(spans[first]), slice(ends[first], ends[past])
                held.append((codes[cut], row[cut], value[cut]))
        if held:
            yield best(at, held)

    spark = blocks.sparkSession
    ship_package(spark)
    names = ["term", "first", "n", "max_tf", "least_terms", "rows", "tfs", "sizes"]
    wanted = blocks.join(F.broadcast(strong.select("term").distinct()), "term", "left_semi").select(*names)
    pieces = wanted.mapInArrow(dealt, "span long, code int, n int, rows binary, tfs binary, sizes binary")
    sums = pieces.repartition("span").sortWithinPartitions("span").mapInArrow(added, "_q int, row_no long, score double")
    ids = T.StructType([T.StructField("_q", T.IntegerType()), T.StructField(query_id, strong.schema[query_id].dataType)])
    named = spark.createDataFrame([(q, held) for held, q in number.items()], ids)
    return sums.join(F.broadcast(named), "_q").select(query_id, "row_no", "score")


def _met(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which is sent to the tasks if its rows are few.

    Otherwise both are shuffled, whatever the size of their files: a stored row
    may take two bytes there and a hundred in the driver, which would send it.
    ``right`` must be cheap to read, as its rows are counted first.
    """
    sent = F.broadcast(right) if has_at_most(right, SENT_ROWS) else right.hint("merge")
    return left.join(sent, list(keys), how)


@dataclass(frozen=True)
class Ranking:
    """The best rows, and which blocks had to be expanded for them out of ``directory``, all blocks of the terms."""

    best: DataFrame
    read: DataFrame
    directory: DataFrame


def rank_blocks(
    blocks: DataFrame,
    totals: DataFrame,
    queries: DataFrame,
    k: int,
    query_id: str = "query_id",
    text: str = "text",
    digits: int = 9,
) -> Ranking:
    """The ``k`` best rows per query, ``row_no`` and ``score``, ties to be cut by the caller.

    The blocks of the highest bounds are expanded first; the k-th best of their
    partial sums is a score that the k-th best row reaches at least. Terms whose bounds
    together stay below it cannot make a candidate: their blocks are only looked
    up where another term names a row. Of the other terms, blocks are left out
    whose bound, with those of all other terms, stays below it. Every row whose
    score reaches the k-th best is found, so ties can be cut by any order.
    Queries of more terms than may be sent are summed in several passes.
    """
    size = totals.agg(F.sum("rows").alias("rows"), F.sum("terms").alias("terms")).select(
        F.struct("rows", F.try_divide("terms", "rows").alias("mean")).alias("s")
    ).scalar()
    asked = stored(query_terms(queries, query_id, text), "query-terms")
    small = has_at_most(asked, QUERY_TERMS)
    send = F.broadcast if small else (lambda df: df.hint("merge"))
    buckets = asked.select(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("b")).distinct()
    there = blocks.where(F.col("bucket").isin([r.b for r in buckets.collect()]))
    asked_terms = send(asked.select("term").distinct())
    directory = stored(there.select(*DIRECTORY).join(asked_terms, "term"), "directory")
    asked_blocks = there.join(asked_terms, "term", "left_semi")
    bound = gain(F.col("max_tf"), F.col("least_terms"), size["mean"])
    per_term = directory.groupBy("term").agg(F.sum("n").alias("rows_n"), F.max(bound).alias("gain"))
    n = F.col("rows_n")
    idf = F.log(1 + (size["rows"] - n + 0.5) / (n + 0.5))
    lists = stored(
        asked.join(send(per_term), "term").withColumn("idf", idf).select(
            query_id, "term", "idf", (F.col("idf") * F.col("gain")).alias("top")
        ),
        "query-lists",
    )

    def scored(part: DataFrame, weights: DataFrame, keys: Sequence[str]) -> DataFrame:
        found = _met(expanded(part), weights, keys)
        value = F.col("idf") * gain(F.col("tf"), F.col("row_terms"), size["mean"])
        return found.groupBy(query_id, "row_no").agg(F.sum(value).alias("score"))

    def these(keys: DataFrame) -> DataFrame:
        """The blocks named by ``term`` and ``first``, with their contents."""
        return _met(asked_blocks, keys, ["term", "first"], "left_semi")

    # the blocks with the highest bounds; their partial sums are scores that some rows reach at least
    promising = top_k(
        directory.select("term", "first", "n", bound.alias("_bound")).join(send(lists), "term"),
        [query_id],
        [F.desc(F.col("idf") * F.col("_bound")), "term", "first"],
        SEEDS * k,
    )
    earlier = W.partitionBy(query_id).orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    seeds = stored(
        promising.withColumn("_before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .where(F.col("_before") < SEEDS * k)
        .select(query_id, "term", "first", "idf"),
        "seed-blocks",
    )
    seed_blocks = stored(seeds.select("term", "first").distinct(), "seeds-read")
    partial = scored(these(seed_blocks), seeds, ["term", "first"])
    kth = top_k(partial, [query_id], [F.desc("score"), "row_no"], k).where(F.col("rank") == k)
    least = kth.select(query_id, (F.col("score") * (1 - SLACK)).alias("least"))
    weakest = W.partitionBy(query_id).orderBy("top", "term").rowsBetween(W.unboundedPreceding, 0)
    lists = stored(
        lists.join(least, query_id, "left")
        .withColumn("least", F.coalesce("least", F.lit(0.0)))
        .withColumn("weak", F.sum("top").over(weakest) < F.col("least"))
        .withColumn("all_top", F.sum("top").over(W.partitionBy(query_id)))
        .withColumn("weak_top", F.sum(F.when(F.col("weak"), F.col("top")).otherwise(0.0)).over(W.partitionBy(query_id))),
        "query-bounds",
    )
    strong = lists.where(~F.col("weak"))
    open_ = directory.join(send(strong), "term").where(
        F.col("idf") * bound + F.col("all_top") - F.col("top") >= F.col("least")
    )
    strong_blocks = open_.select(query_id, "term", "first", "idf")
    # sums of the strong terms, and from them a better score that the k-th best row reaches
    mean = totals.agg(F.try_divide(F.sum("terms"), F.sum("rows"))).first()[0]
    parts = 1 + asked.count() // QUERY_TERMS
    of_part = F.pmod(F.xxhash64(query_id), F.lit(parts))
    summed = [_sums(there, strong.where(of_part == part), mean, k, query_id) for part in range(parts)]
    sums = stored(reduce(DataFrame.unionByName, summed), "sums")
    kth = top_k(sums, [query_id], [F.desc("score"), "row_no"], k).where(F.col("rank") == k)
    reached = kth.select(query_id, (F.col("score") * (1 - SLACK)).alias("_reached"))
    limits = lists.groupBy(query_id).agg(F.first("least").alias("least"), F.first("weak_top").alias("weak_top"))
    limits = limits.join(reached, query_id, "left").withColumn("least", F.greatest("least", "_reached"))
    candidates = stored(
        sums.join(send(limits), query_id).where(F.col("score") + F.col("weak_top") >= F.col("least")).select(
            query_id, "row_no", "score"
        ),
        "candidates",
    )
    # the weak terms of the candidates: rows and the blocks that may hold them meet by term and span
    wanted = candidates.select(query_id, "row_no").join(
        send(lists.where("weak").select(query_id, "term", "idf")), query_id
    ).withColumn("span", F.floor(F.col("row_no") / SPAN))
    spans = F.explode(F.sequence(F.floor(F.col("first") / SPAN), F.floor(F.col("last") / SPAN))).alias("span")
    laid = directory.select("term", "first", "last", spans)
    held = _met(wanted, laid, ["term", "span"]).where("row_no BETWEEN first AND last")
    held = stored(held.select(query_id, "term", "first", "row_no", "idf"), "looked-up")
    held_blocks = stored(held.select("term", "first").distinct(), "looked-up-blocks")
    found = _met(expanded(these(held_blocks)), held, ["term", "first", "row_no"])
    value = F.col("idf") * gain(F.col("tf"), F.col("row_terms"), size["mean"])
    more = found.select(query_id, "row_no", value.alias("score"))
    best = candidates.unionByName(more).groupBy(query_id, "row_no").agg(F.round(F.sum("score"), digits).alias("score"))
    names = strong_blocks.select("term", "first").union(held_blocks).union(seed_blocks)
    read = directory.join(names.distinct(), ["term", "first"], "left_semi")
    return Ranking(best, read, directory)


def search_blocks(
    blocks: DataFrame,
    totals: DataFrame,
    rows: DataFrame,
    queries: DataFrame,
    k: int,
    key: Sequence[str],
    query_id: str = "query_id",
    text: str = "text",
    digits: int = 9,
) -> DataFrame:
    """As ``postings.keyword_search``: the ``k`` best rows per query, ties to the smaller ``key``."""
    best = rank_blocks(blocks, totals, queries, k, query_id, text, digits).best
    # ties with the k-th stay until the keys are known; ranks without gaps let them all pass
    tied = W.partitionBy(query_id).orderBy(F.desc("score"))
    best = stored(best.withColumn("_place", F.rank().over(tied)).where(F.col("_place") <= k).drop("_place"), "best-rows")
    named = _met(rows.select(*key, "row_no"), best, ["row_no"]).drop("row_no")
    return top_k(named.select(query_id, *key, "score"), [query_id], [F.desc("score"), *key], k)
