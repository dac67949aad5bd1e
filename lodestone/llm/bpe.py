"""Byte-level BPE encoding and decoding by replaying the merges over a block of the corpus.

The distinct pieces of a block of documents are laid out as one chain of
tokens. An inverted index holds, for every rank, the places where the pair of
that rank starts. The ranks are replayed in order; a merge touches its two
tokens and the pairs with their neighbours, nothing else. Documents are then
read off piece by piece.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.arrow import flat_list, list_column, text_blocks
from lodestone.llm.pieces import PieceCoder

#: Characters from which pieces are taken one by one instead of as one list.
LONG_TEXT = 1 << 20
NONE = np.int32(2**31 - 1)
WIDE = re.compile("[^\x00-\u024f]")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _members(kind: str) -> str:
    """The code points below U+0250 of a class, written out."""
    return "".join(f"\\u{c:04x}" for c in range(0x250) if regex.match(kind, chr(c)))


def narrow_pattern(pattern: str) -> str:
    """``pattern`` for the standard library, the same over texts of code points below U+0250."""
    kinds = {kind: _members(kind) for kind in (r"\p{L}", r"\p{N}", r"\s")}
    out, inside = [], False
    for part in re.findall(r"\\p\{\w\}|\\.|.", pattern, re.S):
        if part in kinds:
            out.append(kinds[part] if inside else f"[{kinds[part]}]")
        elif part == r"\S" and not inside:
            out.append(f"[^{kinds[chr(92) + 's']}]")
        else:
            inside = part == "[" or (inside and part != "]")
            out.append(part)
    return "".join(out)


class Merges:
    """The merges of a rank file: which pair of ids becomes which id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys = keys[order]
        self.merged = np.fromiter(pairs.values(), np.int32, len(pairs))[order]

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of every pair, ``NONE`` where the pair does not merge."""
        wanted = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.merged[at], NONE)

    def one(self, piece: bytes) -> list[int]:
        """A single piece, lowest rank and leftmost pair first."""
        ids = self.of_byte[np.frombuffer(piece, np.uint8)]
        while len(ids) > 1:
            found = self.rank_of(ids[:-1], ids[1:])
            at = int(np.argmin(found))
            if found[at] == NONE:
                break
            ids = np.concatenate([ids[:at], found[at : at + 1], ids[at + 2 :]])
        return ids.tolist()

    def replay(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in a row and how many each has, all merged together rank by rank."""
        counts = np.zeros(len(pieces), np.int64)
        whole = np.fromiter((self.ranks.get(p, -1) for p in pieces), np.int32, len(pieces))
        counts[whole >= 0] = 1
        parts = np.array([i for i in np.flatnonzero(whole < 0) if pieces[i]], np.int64)
        if not len(parts):
            return whole[whole >= 0], counts
        lengths = np.fromiter((len(pieces[i]) for i in parts), np.int64, len(parts))
        tokens, odd = self._merge(b"".join([pieces[i] for i in parts]), lengths)
        kept = tokens >= 0
        counts[parts] = np.add.reduceat(kept, np.cumsum(lengths) - lengths, dtype=np.int64)
        exact = {int(parts[k]): self.one(pieces[parts[k]]) for k in odd}
        if exact:
            by_piece = np.split(tokens[kept], np.cumsum(counts[parts])[:-1])
            ids = [[int(w)] if w >= 0 else [] for w in whole]
            for k, i in enumerate(parts):
                ids[i] = exact.get(int(i), by_piece[k])
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            return np.fromiter((t for x in ids for t in x), np.int32, int(counts.sum())), counts
        flat = np.empty(int(counts.sum()), np.int32)
        single = (np.cumsum(counts) - counts)[whole >= 0]
        merged = np.ones(len(flat), bool)
        merged[single] = False
        flat[single] = whole[whole >= 0]
        flat[merged] = tokens[kept]
        return flat, counts

    def _merge(self, data: bytes, lengths: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """The chain of tokens after all merges, -1 for places merged away; pieces to do singly."""
        ends = np.cumsum(lengths)
        tokens = self.of_byte[np.frombuffer(data, np.uint8)]
        after = np.arange(1, len(tokens) + 1, dtype=np.int32)
        after[ends - 1] = -1
        before = np.arange(-1, len(tokens) - 1, dtype=np.int32)
        before[ends - lengths] = -1
        rank = np.full(len(tokens), NONE, np.int32)
        heads = np.flatnonzero(after >= 0).astype(np.int32)
        rank[heads] = self.rank_of(tokens[heads], tokens[heads + 1])
        places: dict[int, list[np.ndarray]] = {}
        due: list[int] = []

        def post(at: np.ndarray) -> None:
            ranks = rank[at]
            live = ranks != NONE
            at, ranks = at[live], ranks[live]
            if not len(at):
                return
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            bounds = [0, *cuts.tolist(), len(at)]
            for r, a, b in zip(ranks[bounds[:-1]].tolist(), bounds[:-1], bounds[1:]):
                held = places.get(r)
                if held is None:
                    places[r] = [at[a:b]]
                    heapq.heappush(due, r)
                else:
                    held.append(at[a:b])

        post(heads)
        odd: list[np.ndarray] = []
        while due:
            now = heapq.heappop(due)
            at = np.concatenate(places.pop(now))
            at = np.sort(at[rank[at] == now])
            if not len(at):
                continue
            if len(at) > 1:
                at = at[np.concatenate([[True], at[1:] != at[:-1]])]
                # of overlapping pairs every second one merges, counted from the left
                chained = np.concatenate([[False], after[at[:-1]] == at[1:]])
                if chained.any():
                    index = np.arange(len(at))
                    first = np.maximum.accumulate(np.where(chained, 0, index))
                    at = at[(index - first) % 2 == 0]
            right = after[at]
            beyond = after[right]
            tokens[at] = now
            tokens[right] = -1
            after[at] = beyond
            rank[at] = NONE
            rank[right] = NONE
            inner = beyond >= 0
            before[beyond[inner]] = at[inner]
            earlier = before[at]
            changed = np.concatenate([at[inner], earlier[earlier >= 0]])
            if len(changed):
                found = self.rank_of(tokens[changed], tokens[after[changed]])
                rank[changed] = found
                # a lower rank that only now arises would have come first within its piece
                if found.min() < now:
                    odd.append(changed[found < now])
                post(changed)
        if not odd:
            return tokens, []
        return tokens, np.unique(np.searchsorted(ends, np.concatenate(odd), side="right")).tolist()


class Encoder(PieceCoder):
    def __init__(self, path: str, pattern: str):
        super().__init__()
        self.merges = Merges(read_ranks(path))
        self.pattern = regex.compile(pattern)
        self.narrow = re.compile(narrow_pattern(pattern))

    def cut(self, text: str) -> Iterable[str]:
        pattern = self.pattern if WIDE.search(text) else self.narrow
        if len(text) < LONG_TEXT:
            return pattern.findall(text)
        return (m.group() for m in pattern.finditer(text))

    def ids_of(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.merges.replay([piece.encode() for piece in pieces])


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


@lru_cache(maxsize=2)
def tokens_of(path: str) -> list[bytes]:
    ranks = read_ranks(path)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


def _encoded(batches: Iterable[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    own = encoder(path, pattern)
    for block in text_blocks(batches, "text"):
        ids, bounds = own.encode(block.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays(
            [block.column(0), list_column(ids, bounds, pa.int32())], ["doc_id", "ids"]
        )


def _decoded(batches: Iterable[pa.RecordBatch], tokens: list[bytes]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(1)
        if column.null_count:
            column = pa.array([x or [] for x in column.to_pylist()], column.type)
        values, bounds = flat_list(column)
        out = [
            b"".join([tokens[i] for i in values[a:b].tolist()])
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["doc_id", "ids", "decoded"]
        )


def _schema(docs: DataFrame) -> T.StructType:
    return T.StructType([docs.schema["doc_id"]]).add("ids", T.ArrayType(T.IntegerType()))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``ids`` of every whole text.

    A null or empty text has no ids. Further columns are left out. A text may
    have any length; its ids are one array of up to 2**31 values. Repeated rows
    are encoded each, an empty table gives no rows.
    """
    return docs.select("doc_id", "text").mapInArrow(lambda b: _encoded(b, path, pattern), _schema(docs))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``decoded``, the bytes its ``ids`` stand for; null ids give no bytes."""
    schema = _schema(encoded).add("decoded", T.BinaryType())
    return encoded.select("doc_id", "ids").mapInArrow(lambda b: _decoded(b, tokens_of(path)), schema)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``decode`` of ``encode`` in one pass, so that the ids go through one worker per task."""
    schema = _schema(docs).add("decoded", T.BinaryType())

    def there_and_back(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _decoded(_encoded(batches, path, pattern), encoder(path, pattern).merges.tokens)

    return docs.select("doc_id", "text").mapInArrow(there_and_back, schema)


def digests(decoded: DataFrame, *more: str) -> DataFrame:
    """Per document the number of ids, the digests of ids and bytes, and the columns ``more``."""
    return decoded.select(
        "doc_id",
        *more,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
