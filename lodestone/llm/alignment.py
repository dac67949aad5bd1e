"""Alignment of two tokenizers over the same bytes, and how often ids meet in the corpus.

A text is cut into stretches, white space and what follows it, between which
neither tokenizer joins anything; a worker encodes and aligns every distinct
stretch once. Alignment divides and conquers: a byte offset near the middle at
which tokens of both end is found by bisection, both halves follow alike, and an
interval without such an offset is a group. Tokens of a group whose byte ranges
overlap are linked.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.arrow import binary_column, flat_bytes, text_blocks
from lodestone.llm.id_files import BYTE_LETTERS
from lodestone.llm.pieces import Pieces
from lodestone.llm.tables import stored

#: Stretches, and characters of them, that a worker remembers before it starts afresh; bounds memory, never the result.
KEPT_STRETCHES = 400_000
KEPT_CHARS = 8 << 20
#: Bytes of text whose rows are aligned at a time.
BLOCK = 1 << 20
#: Distinct id pairs whose counts are sent to the tasks, the most frequent ones; the others are joined by key.
SENT_PAIRS = 1_000_000
#: Characters that some library takes for white space; a stretch is never cut behind one of them.
BLANKS = "\\s\x1c-\x1f\x85\u180e\u200b-\u200d\u2060\ufeff\u2581"
FALLBACK = re.compile("<0x([0-9A-F]{2})>")


def shared_groups(ends_a: list[int], ends_b: list[int]) -> tuple[list[int], list[int]]:
    """Where the groups end, as positions behind their last token in A and in B.

    ``ends_a`` and ``ends_b`` are the byte offsets at which tokens end, rising,
    with the same last offset. Empty tokens stay with the token before them.
    """
    if not ends_a and not ends_b:
        return [], []
    past_a, past_b = [], []
    # intervals between two shared cuts, the leftmost on top
    waiting = [(0, len(ends_a), 0, len(ends_b))]
    while waiting:
        a, stop_a, b, stop_b = waiting.pop()
        # the left half is followed at once, right halves wait
        while stop_a - a > 1 and stop_b - b > 1:
            middle = (a + stop_a) // 2 - 1
            end = ends_a[middle]
            at = bisect_left(ends_b, end, b, stop_b)
            if ends_b[at] == end < ends_a[middle + 1] and (at + 1 == stop_b or ends_b[at + 1] > end):
                cut_a, cut_b = middle + 1, at + 1
            else:
                cut = _near_middle(ends_a, ends_b, a, stop_a, b, stop_b)
                if cut is None:
                    break
                cut_a, cut_b = cut
            waiting.append((cut_a, stop_a, cut_b, stop_b))
            stop_a, stop_b = cut_a, cut_b
        past_a.append(stop_a)
        past_b.append(stop_b)
    return past_a, past_b


def _near_middle(ends_a: list[int], ends_b: list[int], a: int, stop_a: int, b: int, stop_b: int) -> tuple[int, int] | None:
    """The shared end inside an interval next to its middle token, as positions behind it; None without one.

    Ends of A are tried from the middle outwards, each by bisection in those of
    B: what is tried in vain is no more than the smaller of the two halves.
    """
    last, middle = ends_a[stop_a - 1], (a + stop_a) // 2 - 1
    for away in range(stop_a - a):
        for k in {middle + away, middle - away}:
            if a <= k < stop_a and ends_a[k] < last:
                at = bisect_left(ends_b, ends_a[k], b, stop_b)
                if ends_b[at] == ends_a[k]:
                    return bisect_right(ends_a, ends_a[k], k, stop_a), bisect_right(ends_b, ends_a[k], at, stop_b)
    return None


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in A and in B of all token pairs whose byte ranges overlap."""
    starts_a = np.concatenate([[0], ends_a[:-1]])
    starts_b = np.concatenate([[0], ends_b[:-1]])
    first = np.searchsorted(ends_b, starts_a, side="right")
    past = np.searchsorted(starts_b, ends_a, side="left")
    counts = np.where(ends_a > starts_a, np.maximum(past - first, 0), 0)
    of_a = np.repeat(np.arange(len(ends_a)), counts)
    of_b = np.arange(counts.sum()) + np.repeat(first - (np.cumsum(counts) - counts), counts)
    filled = ends_b[of_b] > starts_b[of_b]
    return of_a[filled], of_b[filled]


class Pair:
    """The two tokenizers, with the bytes of every token."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        letters = {chr(letter): byte for byte, letter in BYTE_LETTERS.items()}
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            plain = all(c in letters for c in token)
            self.bytes_a[number] = bytes(letters[c] for c in token) if plain else token.encode()
        self.bytes_b = []
        pieces = []
        for number in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(number)
            if self.b.is_byte(number):
                self.bytes_b.append(bytes([int(FALLBACK.fullmatch(piece).group(1), 16)]))
            else:
                self.bytes_b.append(piece.replace("\u2581", " ").encode())
                pieces.append(piece)
        self.size_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.space = self.b.piece_to_id("\u2581")
        self.stretches = self._stretches(pieces)

    def _stretches(self, pieces: list[str]) -> re.Pattern | None:
        """Cuts before a space, line feed or tab behind other characters, where no piece of B reaches across."""
        if any("\u2581" in p.lstrip("\u2581") for p in pieces) or self.b.normalize("a  b ") != "\u2581a\u2581\u2581b\u2581":
            return None
        cuts = " " + "".join(c for c in "\n\t" if not any(c in p for p in pieces))
        other = f"(?![{cuts}])[{BLANKS}]"
        word = f"[{BLANKS}]*[^{BLANKS}]+"
        return re.compile(f"{word}(?:{other}{word})*(?:{other}[{BLANKS}]*\\Z)?|[{BLANKS}]+")

    def cut(self, text: str) -> Iterable[str]:
        """The stretches of a space and ``text``."""
        return [" " + text] if self.stretches is None else self.stretches.findall(" " + text)

    def encode(self, stretches: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of every stretch by A and by B, the latter as within a text: no space is added."""
        ids_a = [x.ids for x in self.a.encode_batch_fast(stretches, add_special_tokens=False)]
        spaced = [s.startswith(" ") for s in stretches]
        ids_b = self.b.encode([s[own:] for s, own in zip(stretches, spaced)], num_threads=1)
        # a lone space comes back empty; before other characters B adds the piece of a space
        ids_b = [x if own else x[1:] for x, own in zip(ids_b, spaced)]
        return ids_a, [[self.space] if s == " " and not x else x for s, x in zip(stretches, ids_b)]


class Aligner:
    """Texts to aligned tokens, every distinct stretch encoded and aligned once."""

    def __init__(self, path_a: str, path_b: str):
        self.pair = Pair(path_a, path_b)
        self.forget()

    def forget(self) -> None:
        self.known = Pieces()
        self.chars = 0
        self.figures = np.zeros((0, 5), np.int64)
        self.groups: list[str] = []
        self.links = np.zeros(0, np.int64)

    def learn(self) -> None:
        """Encode the stretches that came up since the last call and align them as one row of tokens."""
        new, self.known.new = self.known.new, []
        if not new:
            return
        self.chars += sum(map(len, new))
        ids_a, ids_b = self.pair.encode(new)
        n_a = np.fromiter(map(len, ids_a), np.int64, len(new))
        n_b = np.fromiter(map(len, ids_b), np.int64, len(new))
        of_a, of_b = self.pair.bytes_a.__getitem__, self.pair.bytes_b.__getitem__
        whole = [
            b"".join(map(of_a, x)) == b"".join(map(of_b, y)) == s.encode() for x, y, s in zip(ids_a, ids_b, new)
        ]
        used = np.flatnonzero(whole)
        flat_a = np.fromiter(chain.from_iterable(compress(ids_a, whole)), np.int64)
        flat_b = np.fromiter(chain.from_iterable(compress(ids_b, whole)), np.int64)
        ends_a, ends_b = np.cumsum(self.pair.size_a[flat_a]), np.cumsum(self.pair.size_b[flat_b])
        group_a, group_b = shared_groups(ends_a.tolist(), ends_b.tolist())
        of_a, of_b = overlaps(ends_a, ends_b)
        # stretches end at shared cuts, so groups and links fall to one stretch each
        past_a = np.cumsum(n_a[used])
        n_groups, n_links = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        n_groups[used] = np.diff(np.searchsorted(group_a, past_a, side="right"), prepend=0)
        n_links[used] = np.diff(np.searchsorted(of_a, past_a, side="left"), prepend=0)
        names_a, names_b = list(map(str, flat_a.tolist())), list(map(str, flat_b.tolist()))
        texts = [
            f"{names_a[a]}|{names_b[c]}" if b - a == 1 == d - c else ",".join(names_a[a:b]) + "|" + ",".join(names_b[c:d])
            for a, b, c, d in zip([0, *group_a], group_a, [0, *group_b], group_b)
        ]
        bounds = np.concatenate([[0], np.cumsum(n_groups)]).tolist()
        self.groups += [";".join(texts[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
        self.links = np.concatenate([self.links, flat_a[of_a] << 32 | flat_b[of_b]])
        figures = np.stack([n_a, n_b, n_groups, n_links, np.array(whole, np.int64)], axis=1)
        self.figures = np.concatenate([self.figures, figures])

    def align(self, texts: list[str | None]) -> list[pa.Array]:
        """Columns ``n_a, n_b, n_groups, n_links, groups, pairs, times`` of the texts.

        ``pairs`` are the bytes of the distinct linked id pairs, ``times`` those of how often each is linked.
        """
        if len(self.known) > KEPT_STRETCHES or self.chars > KEPT_CHARS:
            self.forget()
        number = self.known.__getitem__
        parts = [np.fromiter(map(number, self.pair.cut(t)) if t else (), np.int64) for t in texts]
        self.learn()
        starts = np.concatenate([[0], np.cumsum(self.figures[:, 3])])
        groups = self.groups.__getitem__
        sums, joined, pairs, times = [], [], [], []
        for part in parts:
            own = self.figures[part].sum(axis=0)
            if own[4] < len(part) or not len(part):
                sums.append(np.zeros(4, np.int64))
                joined.append("")
                found, n = np.zeros(0, np.int64), np.zeros(0, np.int32)
            else:
                sums.append(own[:4])
                joined.append(";".join(filter(None, map(groups, part.tolist()))))
                counts = self.figures[part, 3]
                ends = np.cumsum(counts)
                at = np.arange(int(ends[-1])) + np.repeat(starts[part] - (ends - counts), counts)
                found, n = np.unique(self.links[at], return_counts=True)
            pairs.append(found)
            times.append(n.astype(np.int32))
        sums = np.array(sums, np.int64).reshape(-1, 4)
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in pairs])]).astype(np.int64)
        columns = [pa.array(np.ascontiguousarray(sums[:, k])) for k in range(4)]
        columns.append(pa.array(joined, pa.string()))
        columns.append(binary_column(np.concatenate(pairs), bounds))
        columns.append(binary_column(np.concatenate(times), bounds))
        return columns


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


FIGURES = "n_a long, n_b long, n_groups long, n_links long"


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per row ``doc_id, row_key, n_a, n_b, n_groups, n_links, groups, pairs, times``.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``: the ids of A and of B in every group, in
    order. ``pairs`` and ``times`` are the distinct linked pairs (64-bit numbers,
    A's id in the upper half) and how often each is linked (32-bit numbers), as
    bytes. Strings of special tokens are plain text. A null or empty text, and
    one whose bytes a tokenizer does not give back, has no tokens. ``row_key``
    is unique, repeated rows have one each; it is only fixed once stored. An
    empty table gives no rows; other columns are left out.
    """

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)
        key = TaskContext.get().partitionId() << 40
        for block in text_blocks(batches, "text", BLOCK):
            keys = pa.array(np.arange(key, key + block.num_rows))
            key += block.num_rows
            columns = [block.column(0), keys, *own.align(block.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    figures = T.StructType.fromDDL(f"row_key long, {FIGURES}, groups string, pairs binary, times binary")
    schema = T.StructType([docs.schema["doc_id"], *figures.fields])
    return docs.select("doc_id", "text").mapInArrow(blocks, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Per linked pair of ids: ``pair``, ``a``, ``n`` (rows that hold it) and ``best`` (no pair of ``a`` has more)."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, n = np.unique(flat_bytes(batch.column(0))[0].view("<i8"), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], ["pair", "n"])

    counts = aligned.select("pairs").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = stored(counts.withColumn("a", F.shiftright("pair", 32)), "pair-counts")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(most, "a").select("pair", "a", "n", (F.col("n") == F.col("most")).alias("best"))


def _sent(counts: DataFrame, at_most: int) -> int:
    """The smallest count so that no more than ``at_most`` pairs have it or a higher one.

    Counts are taken by their length in bits first, one row per length, so that
    little meets in one place; ties with the last that fits are left out.
    """
    bits = F.length(F.bin("n"))
    sizes = sorted(((r.bits, r.pairs) for r in counts.groupBy(bits.alias("bits")).agg(F.count("*").alias("pairs")).collect()), reverse=True)
    held, least = 0, None
    for length, pairs in sizes:
        if held + pairs > at_most:
            break
        held, least = held + pairs, 1 << (length - 1)
    return (1 << 62) if least is None else least


def weigh(aligned: DataFrame, counts: DataFrame, sent_pairs: int = SENT_PAIRS) -> DataFrame:
    """``aligned`` with ``n_best`` and ``count_sum``: its links whose pair is best, and the counts of all its links.

    The most frequent pairs, at most ``sent_pairs``, are sent to the tasks and
    looked up there. What is not among them is rare by construction: those pairs
    of a row meet their counts by key and come back as one sum per row.
    """
    counts = stored(counts, "pair-weights")
    least = _sent(counts, sent_pairs)
    frequent = counts.filter(F.col("n") >= least).select("pair", "n", "best").toArrow()
    keys = frequent.column(0).to_numpy()
    order = np.argsort(keys)
    table = aligned.sparkSession.sparkContext.broadcast(
        (keys[order], frequent.column(1).to_numpy()[order], frequent.column(2).to_numpy()[order])
    )
    kept = [f for f in aligned.schema if f.name not in ("pairs", "times")]
    names = [f.name for f in kept]
    more = T.StructType.fromDDL("n_best long, count_sum long, rare array<bigint>, rare_times array<int>")
    schema = T.StructType([*kept, *more.fields])

    def look_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = table.value
        for batch in batches:
            pairs, bounds = flat_bytes(batch.column(len(names)))
            pairs, bounds = pairs.view("<i8"), bounds // 8
            times = flat_bytes(batch.column(len(names) + 1))[0].view("<i4").astype(np.int64)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
                known = keys[at] == pairs
                sums, bests = times * n[at] * known, times * best[at] * known
            else:
                known = np.zeros(len(pairs), bool)
                sums = bests = np.zeros(len(pairs), np.int64)

            def per_row(values: np.ndarray) -> np.ndarray:
                total = np.concatenate([[0], np.cumsum(values)])
                return total[bounds[1:]] - total[bounds[:-1]]

            rare = np.flatnonzero(~known)
            cut = pa.array(np.searchsorted(rare, bounds).astype(np.int32))
            columns = [batch.column(k) for k in range(len(names))]
            columns += [pa.array(per_row(bests)), pa.array(per_row(sums))]
            columns.append(pa.ListArray.from_arrays(cut, pa.array(pairs[rare])))
            columns.append(pa.ListArray.from_arrays(cut, pa.array(times[rare].astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    looked = aligned.select(*names, "pairs", "times").mapInArrow(look_up, schema)
    if counts.filter(F.col("n") < least).limit(1).count() == 0:
        return looked.drop("rare", "rare_times")
    looked = stored(looked, "weighed")
    rare = looked.select("row_key", F.inline(F.arrays_zip(F.col("rare").alias("pair"), F.col("rare_times").alias("times"))))
    more = (
        rare.join(counts.filter(F.col("n") < least), "pair")
        .groupBy("row_key")
        .agg(F.sum(F.expr("times * n")).alias("_sum"), F.sum(F.expr("if(best, times, 0)")).alias("_best"))
    )
    joined = looked.join(more, "row_key", "left")
    return joined.select(
        *names,
        (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum"),
    )
