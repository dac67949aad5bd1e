"""Passages that repeat across documents, by small content-defined chunks.

A gear rolling hash over words cuts every text at its peaks, about every five
words, however long the words are. A cut depends on the words around it alone,
so an insertion moves the chunks but changes only those it touches. Chunks are
deduplicated by digest over the whole corpus; neighbouring chunks that all
occur in other documents too make a passage.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.arrow import flat_bytes, list_column, text_blocks
from lodestone.llm.chunking import chunk_digests, peak_ends, starts_of, word_chunk_digests, word_gear
from lodestone.llm.tables import input_partitions, stored

#: Words that the hash of a place covers.
COVERED = 2
#: Words on either side over which a cut is the peak of the hash.
REACH = 2
#: Words of whole repeated chunks that make a passage. A passage of 50 words
#: loses some 11 to the chunks at its ends, which reach beyond it; of 20,000
#: passages at random one kept fewer than 25.
PASSAGE_WORDS = 25
#: Digests that make up more than this share of all chunks are sent, not joined.
HOT_SHARE = 1000
BLOCK = 2 << 20


def word_places(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of a block of texts begin and end, and at which word each text begins."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    begins = np.flatnonzero(~space & (edge[:-1] | np.concatenate([[True], space[:-1]])))
    stops = np.flatnonzero(~space & (edge[1:] | np.concatenate([space[1:], [True]]))) + 1
    return begins, stops, np.searchsorted(begins, bounds)


def chunk_lists(docs: DataFrame) -> DataFrame:
    """Per document lists over its chunks: ``digests``, ``words``, and the bytes from ``starts`` to ``ends``.

    Chunks are whole words; what stands between words is no part of a digest.
    """

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "text", BLOCK):
            data, bounds = flat_bytes(block.column(1))
            begins, stops, texts = word_places(data, bounds)
            lengths = stops - begins
            spelt = data[np.repeat(begins - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))]
            words = chunk_digests(spelt, np.cumsum(lengths))
            ends = peak_ends(word_gear(words), texts, COVERED, REACH)
            starts = starts_of(ends)
            document = np.searchsorted(texts, starts, side="right") - 1
            offsets = np.searchsorted(document, np.arange(len(bounds)))
            base = bounds[document]
            yield pa.RecordBatch.from_arrays(
                [
                    block.column(0),
                    list_column(word_chunk_digests(words, ends), offsets, pa.int64()),
                    list_column(ends - starts, offsets, pa.int32()),
                    list_column(begins[starts] - base, offsets, pa.int32()),
                    list_column(stops[ends - 1] - base, offsets, pa.int32()),
                ],
                ["doc_id", "digests", "words", "starts", "ends"],
            )

    numbers = T.ArrayType(T.IntegerType())
    schema = T.StructType([docs.schema["doc_id"]]).add("digests", T.ArrayType(T.LongType()))
    for name in ("words", "starts", "ends"):
        schema = schema.add(name, numbers)
    return docs.select("doc_id", "text").mapInArrow(blocks, schema)


def repeated_passages(docs: DataFrame, passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """One row per passage that also occurs in another document.

    ``doc_id``, ``start_byte`` and ``end_byte`` (of the UTF-8 text, whole words),
    ``n_words`` (words that begin in it), ``first_words`` (those of chunks that occur here first, in the
    order of the input) and ``kept`` (most of them do). Passages have
    ``passage_words`` words or more in whole chunks. Repeated rows count as
    different documents; null and empty texts and texts without words have no
    chunks, an empty table gives no rows; repeats within one document alone are
    none. Columns beside ``doc_id`` and ``text`` are not read.
    """
    lists = chunk_lists(docs).withColumn("row", F.monotonically_increasing_id())
    held = stored(lists, "chunks")
    counted = held.select("row", F.explode("digests").alias("digest")).groupBy("digest").agg(
        F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.count(F.lit(1)).alias("times")
    )
    shared = stored(counted.filter("first_row < last_row").drop("last_row"), "shared")
    total = held.agg(F.sum(F.size("digests"))).first()[0] or 0
    # no more than HOT_SHARE digests can be above that share, whatever the input
    often = F.col("times") * HOT_SHARE > total
    hot = F.broadcast(shared.where(often).select("digest", "first_row"))
    chunks = held.select(
        "row", F.posexplode(F.arrays_zip("digests", "words", "starts", "ends")).alias("place", "chunk")
    ).select("row", "place", "chunk.*").withColumnRenamed("digests", "digest")
    found = chunks.join(hot, "digest").unionByName(
        chunks.join(hot.select("digest"), "digest", "left_anti").join(
            shared.where(~often).select("digest", "first_row"), "digest"
        )
    )

    def runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            row, place = (batch.column(n).to_numpy() for n in ("row", "place"))
            cuts = np.flatnonzero((row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)) + 1
            if last is not None and last != (row[0], place[0] - 1):
                cuts = np.concatenate([[0], cuts])
            last = (row[-1], place[-1])
            if not len(cuts):
                waiting.append(batch)
                continue
            until = int(cuts[-1])
            block = pa.Table.from_batches([*waiting, batch.slice(0, until)])
            ahead = sum(b.num_rows for b in waiting)
            at = np.unique(np.concatenate([[0], cuts[:-1] + ahead]))
            yield passages(block, at[at < block.num_rows])
            waiting = [batch.slice(until)]
        if waiting:
            yield passages(pa.Table.from_batches(waiting), np.array([0]))

    def passages(block: pa.Table, at: np.ndarray) -> pa.RecordBatch:
        row, words, first_row = (block.column(n).to_numpy() for n in ("row", "words", "first_row"))
        until = np.concatenate([at[1:], [block.num_rows]]) - 1
        total = np.add.reduceat(words.astype(np.int64), at)
        own = np.add.reduceat(np.where(first_row == row, words, 0).astype(np.int64), at)
        keep = total >= passage_words
        lo, hi = block.column("starts").to_numpy()[at], block.column("ends").to_numpy()[until]
        columns = [row[at], lo.astype(np.int64), hi.astype(np.int64), total, own]
        names = ["row", "start_byte", "end_byte", "n_words", "first_words"]
        return pa.RecordBatch.from_arrays([pa.array(c[keep], pa.int64()) for c in columns], names)

    dealt = (
        found.select("row", "place", "words", "starts", "ends", "first_row")
        .repartition(input_partitions(docs), "row")
        .sortWithinPartitions("row", "place")
    )
    spans = dealt.mapInArrow(
        runs, "row long, start_byte long, end_byte long, n_words long, first_words long"
    )
    names = held.select("row", "doc_id")
    return spans.join(names, "row").select(
        "doc_id",
        "start_byte",
        "end_byte",
        "n_words",
        "first_words",
        (F.col("first_words") * 2 >= F.col("n_words")).alias("kept"),
    )
