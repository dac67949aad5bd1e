"""Token ids in files: frequency-ranked, byte-aligned, control bytes apart from the data.

An id is replaced by its rank in the corpus, so frequent ids are small numbers.
A number takes one to four bytes; two bits tell how many, and the bits of four
numbers make a control byte. A block holds whole documents; reading it back is
a table lookup of the control bytes and one gather.

Blocks are rows of Parquet files: Spark commits them as a whole, so a lost
executor leaves no half-written shard, on any store that Spark can write to.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.arrow import binary_column, flat_bytes, list_column, text_blocks
from lodestone.llm.pieces import PieceCoder
from lodestone.llm.tables import input_partitions, stored
from lodestone.session import has_at_most

#: Ids of a block, unless a single document has more.
BLOCK_IDS = 1 << 18
#: Distinct words a worker remembers before it starts afresh; bounds memory, never the result.
KEPT_WORDS = 300_000
#: Shards up to which their totals are sent to the tasks; beyond it documents are dealt by shard.
SENT_SHARDS = 1_000_000
#: White space of Unicode; str.split() alone would also split at U+001C to U+001F.
SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
PLAIN_WORD = re.compile("([A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff]+)([.,;:!?]*)")
SEPARATORS = re.compile("[\x1c-\x1f]")
#: How many bytes each of the four numbers of a control byte takes.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """The control bytes and the data bytes of unsigned 32-bit numbers."""
    values = np.ascontiguousarray(values, "<u4")
    extra = (values > 0xFF).astype(np.uint8)
    extra += values > 0xFFFF
    extra += values > 0xFFFFFF
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]]
    padded = np.zeros((-(-len(extra) // 4), 4), np.uint8)
    padded.reshape(-1)[: len(extra)] = extra
    control = np.bitwise_or.reduce(padded << np.array([0, 2, 4, 6], np.uint8), axis=1)
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The ``count`` numbers of ``pack``."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:count]
    out = np.zeros((count, 4), np.uint8)
    out[np.arange(4) < lengths[:, None]] = np.frombuffer(data, np.uint8)
    return out.view("<u4").reshape(-1)


def byte_letters() -> dict[int, int]:
    """The letter that byte-level pre-tokenizers write for every byte: itself where it is printable."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {**{b: b for b in plain}, **{b: 256 + k for k, b in enumerate(other)}}


BYTE_LETTERS = byte_letters()


class WordCoder(PieceCoder):
    """Ids of the tokenizers library, every distinct word encoded once.

    The normaliser and the pre-tokenizer of the file never join what white
    space separates, so words can go through the library's steps one by one;
    the model sees a distinct piece once. For plain words of Latin letters the
    steps before the model come down to lower case and byte letters.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # strings that the library takes out of the raw text before any other step
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in added.values()):
            raise ValueError("added tokens that depend on the text around them")
        self.added = {token.content: number for number, token in added.items()}
        longest = sorted(map(re.escape, self.added), key=len, reverse=True)
        self.added_pattern = re.compile(f"({'|'.join(longest)})") if longest else None
        #: The ids of a piece as bytes, a third of the memory of a list of numbers.
        self.piece_ids: dict[str, bytes] = {}
        super().__init__(KEPT_WORDS)

    def cut(self, text: str) -> Iterable[str]:
        if any(map(text.__contains__, self.added)):
            words: list[str] = []
            for k, part in enumerate(self.added_pattern.split(text)):
                words += [part] if k % 2 else self.words(part)
            return words
        return self.words(text)

    def words(self, text: str) -> Iterable[str]:
        if SEPARATORS.search(text):
            return [word for word in SPACES.split(text) if word]
        return text.split()

    def parts(self, word: str) -> list[str]:
        """The pieces of a word as the model takes them; an added token is one piece."""
        if word in self.added:
            return [word]
        plain = PLAIN_WORD.fullmatch(word)
        if plain is None:
            normal = self.tokenizer.normalizer.normalize_str(word)
            return [piece for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]
        letters, mark = plain.groups()
        letters = letters.lower()
        if not letters.isascii():
            letters = letters.encode().decode("latin-1").translate(BYTE_LETTERS)
        return [letters, mark] if mark else [letters]

    def ids_of(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.piece_ids) > KEPT_WORDS:
            self.piece_ids.clear()
        model, known = self.tokenizer.model, self.piece_ids
        ends, out = [0], bytearray()
        for word in pieces:
            for piece in self.parts(word):
                ids = known.get(piece)
                if ids is None:
                    own = self.added.get(piece)
                    numbers = [token.id for token in model.tokenize(piece)] if own is None else [own]
                    ids = known[piece] = array("i", numbers).tobytes()
                out += ids
            ends.append(len(out))
        return np.frombuffer(out, np.int32), np.diff(np.array(ends, np.int64)) // 4


@lru_cache(maxsize=2)
def word_coder(path: str) -> WordCoder:
    return WordCoder(path)


def id_type(path: str, end_id: int) -> str:
    """The smallest of unsigned 16-bit and 32-bit little-endian numbers that holds all ids of a file."""
    largest = max([end_id, *word_coder(path).tokenizer.get_vocab(with_added_tokens=True).values()])
    return "<u2" if largest < 1 << 16 else "<u4"


def encode(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """``doc_id`` and ``ids`` of every whole text, ``end_id`` last; a null text has that id alone.

    ``ids`` are the bytes of numbers of ``id_type``.
    """
    kind = id_type(path, end_id)

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_coder(path)
        for block in text_blocks(batches, "text"):
            ids, bounds = coder.encode(block.column(1).to_pylist())
            ids = np.insert(ids, bounds[1:], end_id).astype(kind)
            bounds = bounds + np.arange(len(bounds))
            yield pa.RecordBatch.from_arrays([block.column(0), binary_column(ids, bounds)], ["doc_id", "ids"])

    schema = T.StructType([docs.schema["doc_id"]]).add("ids", "binary")
    return docs.select("doc_id", "text").mapInArrow(blocks, schema)


def frequency_order(encoded: DataFrame, kind: str = "<u4") -> list[int]:
    """All ids that occur, most frequent first; one number per entry of the vocabulary."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            own = np.bincount(flat_bytes(batch.column(0))[0].view(kind), minlength=len(total))
            own[: len(total)] += total
            total = own
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], ["id", "n"])

    counts = encoded.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return [r.id for r in sorted(counts.collect(), key=lambda r: (-r.n, r.id))]


BLOCKS = "shard int, block int, start long, doc_ids array<{}>, counts array<int>, control binary, data binary"


def write(encoded: DataFrame, folder: str, shards: int, kind: str = "<u4") -> None:
    """Write ``doc_id`` and ``ids`` (bytes of numbers of ``kind``) to ``folder`` in ascending order of ``doc_id``, nulls first.

    Rows of one ``doc_id`` follow each other in an order fixed by their ids.
    The order of ids by frequency takes one number per vocabulary entry on the
    driver and in every task, however large the corpus is.
    """
    spark = encoded.sparkSession
    order = frequency_order(encoded, kind)
    rank = np.zeros(max(order, default=0) + 1, np.uint32)
    rank[order] = np.arange(len(order))
    doc_type = encoded.schema["doc_id"].dataType

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        block, start = 0, 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def row() -> pa.RecordBatch:
            nonlocal block, start
            doc_ids = pa.concat_arrays([x[0] for x in held])
            counts = np.concatenate([x[1] for x in held])
            values = np.concatenate([x[2] for x in held])
            control, data = pack(rank[values])
            at = [0, len(counts)]
            out = [
                pa.array([shard], pa.int32()),
                pa.array([block], pa.int32()),
                pa.array([start], pa.int64()),
                pa.ListArray.from_arrays(pa.array(at, pa.int32()), doc_ids),
                list_column(counts, np.array(at), pa.int32()),
                pa.array([control], pa.binary()),
                pa.array([data], pa.binary()),
            ]
            block, start = block + 1, start + len(values)
            held.clear()
            names = [x.split()[0] for x in BLOCKS.split(", ")]
            return pa.RecordBatch.from_arrays(out, names)

        for batch in batches:
            data, bounds = flat_bytes(batch.column(1))
            values, bounds = data.view(kind), bounds // np.dtype(kind).itemsize
            counts = np.diff(bounds)
            first = 0
            while first < len(counts):
                room = BLOCK_IDS - sum(len(x[2]) for x in held)
                last = int(np.searchsorted(bounds, bounds[first] + room, side="right")) - 1
                last = min(last, len(counts))
                if last <= first:
                    if held:
                        yield row()
                        continue
                    last = first + 1
                part = values[bounds[first] : bounds[last]]
                held.append((batch.column(0).slice(first, last - first), counts[first:last], part))
                first = last
        if held:
            yield row()

    keys = ["doc_id", F.xxhash64("ids"), "ids"]
    ordered = encoded.repartitionByRange(shards, *keys[:2]).sortWithinPartitions(*keys)
    ordered.mapInArrow(code, BLOCKS.format(doc_type.simpleString())).write.parquet(f"{folder}/blocks")
    names = spark.createDataFrame([(order,)], "ids array<int>")
    names.coalesce(1).write.parquet(f"{folder}/order")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of ``write``: ``doc_id``, ``start`` (ids of all documents before it), ``ids``.

    ``ids`` are the bytes of unsigned 32-bit little-endian numbers.
    """
    order = np.array(spark.read.parquet(f"{folder}/order").first().ids, np.uint32)
    blocks = spark.read.parquet(f"{folder}/blocks")
    doc_type = blocks.schema["doc_ids"].dataType.elementType

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                doc_ids = batch.column(2)[k].values
                counts = batch.column(3)[k].values.to_numpy()
                bounds = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
                ids = order[unpack(batch.column(4)[k].as_py(), batch.column(5)[k].as_py(), bounds[-1])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(counts), batch.column(0)[k].as_py()), pa.int32()),
                        doc_ids,
                        pa.array(batch.column(1)[k].as_py() + bounds[:-1], pa.int64()),
                        binary_column(ids.astype("<u4"), bounds),
                    ],
                    ["shard", "doc_id", "start", "ids"],
                )

    schema = T.StructType().add("shard", "integer").add("doc_id", doc_type).add("start", "long")
    found = blocks.select("shard", "start", "doc_ids", "counts", "control", "data").mapInArrow(
        decode, schema.add("ids", "binary")
    )
    totals = blocks.groupBy("shard").agg(
        F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("total")
    )
    before = F.sum("total").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    totals = totals.select("shard", F.coalesce(before, F.lit(0)).alias("before"))
    side = F.broadcast(totals) if has_at_most(totals, SENT_SHARDS) else totals
    return found.join(side, "shard").select(
        "doc_id", (F.col("before") + F.col("start")).alias("start"), "ids"
    )


def write_texts(docs: DataFrame, path: str, end_id: int, folder: str) -> DataFrame:
    """Encode ``docs``, write the files to ``folder`` and read them back."""
    encoded = stored(encode(docs, path, end_id), "ids")
    write(encoded, folder, input_partitions(docs), id_type(path, end_id))
    return read(docs.sparkSession, folder)
