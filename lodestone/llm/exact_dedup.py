"""Exact duplicates through recipes: documents as lists of identifiers of verified chunks.

Texts are cut by content into chunks of about 2 KiB. A chunk's identifier is a
64-bit fingerprint. Every distinct chunk travels once per task to the task that
owns its fingerprint, where its bytes are compared; a fingerprint that stands
for different bytes is followed in the recipes by the SHA-256 of the chunk. Equal
recipes are then equal texts, and only recipes move: about 0.4 % of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.arrow import flat_bytes, list_column, text_blocks
from lodestone.llm.chunking import masked_ends, starts_of
from lodestone.llm.tables import input_partitions, packed, stored

#: Chunks are about 2 ** CHUNK_BITS bytes long and never longer than LONGEST.
CHUNK_BITS = 11
LONGEST = 1 << 14
#: Fingerprints of different chunks that a run may meet. 64 bits give some 70 of
#: them over 100 TB; more than this means that the fingerprint is too narrow.
MOST_COLLISIONS = 1_000_000


def _chunks(block: pa.RecordBatch) -> tuple[memoryview, np.ndarray, np.ndarray, np.ndarray]:
    data, bounds = flat_bytes(block.column(1))
    ends = masked_ends(data, bounds, CHUNK_BITS, LONGEST)
    return memoryview(data), bounds, starts_of(ends), ends


def _fingerprint(chunk: memoryview, bits: int) -> int:
    digest = hashlib.blake2b(chunk, digest_size=8).digest()
    return int.from_bytes(digest, "little", signed=True) >> (64 - bits)


def collisions(docs: DataFrame, bits: int = 64) -> list[int]:
    """Fingerprints that stand for different chunks, by comparing the chunks' bytes."""

    def distinct(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, bytes] = {}
        sent: set[int] = set()
        for block in text_blocks(batches, "text"):
            view, _, starts, ends = _chunks(block)
            prints, chunks = [], []
            for a, b in zip(starts.tolist(), ends.tolist()):
                chunk = view[a:b]
                mark = _fingerprint(chunk, bits)
                check = hashlib.sha256(chunk).digest()
                if seen.setdefault(mark, check) == check and mark in sent:
                    continue
                sent.add(mark)
                prints.append(mark)
                chunks.append(bytes(chunk))
            yield pa.RecordBatch.from_arrays(
                [pa.array(prints, pa.int64()), pa.array(chunks, pa.binary())], ["mark", "chunk"]
            )

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark, first = None, None
        for batch in batches:
            found = set()
            for own, chunk in zip(batch.column(0).to_pylist(), batch.column(1)):
                if own != mark:
                    mark, first = own, chunk.as_py()
                elif own not in found and chunk.as_py() != first:
                    found.add(own)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64())], ["mark"])

    moved = docs.select("doc_id", "text").mapInArrow(distinct, "mark long, chunk binary")
    owned = moved.repartition(input_partitions(docs), "mark").sortWithinPartitions("mark")
    found = owned.mapInArrow(compare, "mark long").distinct().limit(MOST_COLLISIONS + 1).collect()
    if len(found) > MOST_COLLISIONS:
        raise ValueError(f"more than {MOST_COLLISIONS} fingerprints of {bits} bits collide")
    return [r.mark for r in found]


def recipes(docs: DataFrame, colliding: list[int], bits: int = 64) -> DataFrame:
    """``doc_id``, ``text_sha256`` and ``recipe``, the ordered identifiers of the chunks of every text."""
    doubtful = frozenset(colliding)

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "text"):
            view, bounds, starts, ends = _chunks(block)
            marks: list[int] = []
            sizes = np.ones(len(ends), np.int64)
            for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
                mark = _fingerprint(view[a:b], bits)
                marks.append(mark)
                if mark in doubtful:
                    marks.extend(np.frombuffer(hashlib.sha256(view[a:b]).digest(), "<i8").tolist())
                    sizes[k] = 5
            total = np.concatenate([[0], np.cumsum(sizes)])
            cut = bounds.tolist()
            digests = [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(cut, cut[1:])]
            offsets = total[np.searchsorted(ends, bounds, side="right")]
            offsets[0] = 0
            yield pa.RecordBatch.from_arrays(
                [
                    block.column(0),
                    pa.array(digests, pa.string()),
                    list_column(np.array(marks, np.int64), offsets, pa.int64()),
                ],
                ["doc_id", "text_sha256", "recipe"],
            )

    schema = T.StructType([docs.schema["doc_id"]]).add("text_sha256", "string")
    return docs.select("doc_id", "text").mapInArrow(blocks, schema.add("recipe", T.ArrayType(T.LongType())))


def exact_duplicates(docs: DataFrame, bits: int = 64) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256, n_chunks``.

    Texts are equal when their bytes are; null counts as empty, and empty texts
    are equal. The largest ``doc_id`` stays, a null one only where a group has
    no other; of repeated rows with that ``doc_id`` exactly one is ``kept``.
    An empty table gives no rows, columns beside ``doc_id`` and ``text`` are not read.
    """
    docs = docs.select("doc_id", "text")
    made = recipes(docs, collisions(docs, bits), bits)
    made = made.withColumn("row", F.monotonically_increasing_id())
    # two sizes of one key: the join deals both sides anew, so that a hot recipe can be split
    held = stored(made.withColumn("n_chunks", F.size("recipe").cast("long")), "recipes")
    groups = held.groupBy("recipe").agg(
        F.max(F.struct("doc_id", "row")).alias("keep"),
        F.count("*").alias("group_size"),
        F.first("n_chunks").alias("n_chunks"),
    )
    return held.join(groups, ["recipe", "n_chunks"]).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"),
        "text_sha256",
        "n_chunks",
    )


def keep_exact(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``exact_duplicates`` keeps, with all their columns."""
    found = exact_duplicates(docs).groupBy("doc_id", "text_sha256").agg(
        F.max("kept").alias("_kept"), F.count("*").alias("_copies")
    )
    # only what goes, and the rare rows that repeat id and text, need a look
    marked = found.filter("NOT _kept OR _copies > 1").withColumnsRenamed(
        {"doc_id": "_doc_id", "text_sha256": "_sha"}
    )
    sha = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    own = packed(docs, "doc_id", sha.alias("sha")).join(
        marked, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("sha") == F.col("_sha")), "left"
    )
    once = own.filter("_kept IS NULL").select("row")
    again = own.filter("_kept").dropDuplicates(["sha"]).select("row")
    return once.union(again).select("row.*")
