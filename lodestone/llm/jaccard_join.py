"""Near duplicates: an exact Jaccard join of word shingles in regions around pivots.

Regions. Shingles have one global order, rarest first by a count sketch over all
texts. Texts of similarity t share a shingle among the first (1 - t) n + 1 of
each, so a shingle there is the seed of a cell: all texts that have it. Every
cell names its most central member as pivot, the one whose first shingles are
the most common, which in a group of edited copies is the least edited one. The
cells of one pivot make its region. A text thus lies in the region of its own
pivot and, as a guest, in those of all pivots through which a partner could be met.

Windows. Every set has a profile, its counts over 256 classes of shingles. The
differences of two profiles add up to no more than the symmetric difference of
the sets (the triangle inequality with a class as pivot), so profiles too far
apart cannot link. Only texts that have a partner within reach in a region have
their sets sent there; the others, which share a passage at most, stay behind.

Join. In a region all distances to the pivot are measured. What lies within the
threshold is linked to the pivot and needs no comparison with each other. Every
other text becomes a pivot in turn for those that the triangle inequality
leaves, distances to the first pivot that differ by no more than the threshold.
A region too large for a task first links its members to the pivot in a join;
only those left over then meet the whole region, block by block.

Links are reported as spanning edges, never as all pairs. Equal sets are one node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.arrow import flat_list, list_column, text_blocks
from lodestone.llm.components import components
from lodestone.llm.shingles import shingle_sets
from lodestone.llm.tables import input_partitions, no_rows, packed, stored
from lodestone.session import has_at_most

BLOCK = 4 << 20
#: Counters of the sketch, whatever the size of the corpus; 4 bytes each, cut in rows.
SKETCH_BITS = 20
ROW_BITS = 14
#: Shingles of all members of a region that one task takes at once.
REGION_ITEMS = 2_000_000
#: Classes of a profile, a byte each.
CLASSES = 256
#: Members of a region whose profiles are compared; all members of a larger one stay.
COMPARED = 2000
#: Large regions up to which their pivots are sent to the tasks; 8 bytes each.
SENT_PIVOTS = 1_000_000
#: Documents with a region up to which their ids are sent to the scan of the texts.
SENT_DOCS = 500_000
#: Bits of a packed pivot that name the node; the bits above hold how central it is.
NODE_BITS = 55


def _mark() -> Column:
    """Tells the texts of one id apart; never null."""
    return F.xxhash64("text").alias("mark")


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes.view(np.uint64) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def sketch(docs: DataFrame, words: int) -> np.ndarray:
    """How common the shingles of a bucket are over all texts, in quarters of a power of two."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.uint32)
        for block in text_blocks(batches, "text", BLOCK):
            sets = list(shingle_sets(block.column(0), words))
            total += np.bincount(_bucket(np.concatenate(sets)), minlength=len(total)).astype(np.uint32)
        for k, part in enumerate(total.reshape(-1, 1 << ROW_BITS)):
            yield pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["k", "counts"]
            )

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(value.as_py(), np.uint32)
                held[k] = held[k] + part if k in held else part.astype(np.uint64)
        for k, part in held.items():
            level = np.minimum(4 * np.log2(1 + part.astype(float)), 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["k", "level"]
            )

    parts = docs.select("text").mapInArrow(count, "k int, counts binary")
    rows = 1 << (SKETCH_BITS - ROW_BITS)
    summed = parts.repartition(rows, "k").mapInArrow(add, "k int, level binary").collect()
    levels = np.zeros((rows, 1 << ROW_BITS), np.uint8)
    for r in summed:  # a fixed number of rows of fixed size
        levels[r.k] = np.frombuffer(r.level, np.uint8)
    return levels.reshape(-1)


def _digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def prefixes(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Per document ``doc_id, n, digest, profile`` of its set, its first shingles as ``prefix``, and ``central``.

    Columns of ``docs`` beside ``doc_id`` and ``text`` are passed on.
    """
    more = [c for c in docs.columns if c not in ("doc_id", "text")]
    levels = docs.sparkSession.sparkContext.broadcast(sketch(docs, words))

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "text", BLOCK):
            counts, digests, first, central, profiles = [], [], [], [], []
            for own in shingle_sets(block.column(1), words):
                size = len(own)
                level = levels.value[_bucket(own)]
                order = np.lexsort((own, level))[: size - -(-percent * size // 100) + 1 if size else 0]
                counts.append(size)
                digests.append(_digest(own))
                first.append(own[order])
                central.append(int(level[order].mean()) if size else 0)
                profile = np.bincount(own & (CLASSES - 1), minlength=CLASSES)
                profiles.append(np.minimum(profile, 255).astype(np.uint8).tobytes())
            ends = np.cumsum([0, *map(len, first)])
            yield pa.RecordBatch.from_arrays(
                [
                    block.column(0),
                    pa.array(counts, pa.int64()),
                    pa.array(digests, pa.binary()),
                    list_column(np.concatenate(first), ends, pa.int64()),
                    pa.array(central, pa.int32()),
                    pa.array(profiles, pa.binary()),
                    *block.columns[2:],
                ],
                ["doc_id", "n", "digest", "prefix", "central", "profile", *more],
            )

    schema = T.StructType([docs.schema["doc_id"]]).add("n", "long").add("digest", "binary")
    schema = schema.add("prefix", T.ArrayType(T.LongType())).add("central", "integer").add("profile", "binary")
    for name in more:
        schema = schema.add(docs.schema[name])
    return docs.select("doc_id", "text", *more).mapInArrow(blocks, schema)


def partners(profiles: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Which members of a region have another one that their size and profile do not rule out."""
    order = np.argsort(sizes, kind="stable")
    sizes, profiles = sizes[order], profiles[order].astype(np.int16)
    ends = np.searchsorted(percent * sizes, 100 * sizes, side="right")
    keep = np.zeros(len(sizes), bool)
    for k, end in enumerate(ends.tolist()):
        if end > k + 1:
            apart = np.abs(profiles[k + 1 : end] - profiles[k]).sum(axis=1, dtype=np.int64)
            near = apart * (100 + percent) <= (100 - percent) * (sizes[k + 1 : end] + sizes[k])
            keep[k + 1 : end] |= near
            keep[k] |= near.any()
    out = np.zeros(len(sizes), bool)
    out[order] = keep
    return out


def windowed(member: DataFrame, nodes: DataFrame, percent: int, partitions: int) -> DataFrame:
    """The rows of ``member`` that have a possible partner in their region, and the pivots of those regions."""

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def survivors() -> pa.RecordBatch:
            found = []
            if len(held) > 1:
                profiles = np.frombuffer(b"".join(h[2] for h in held), np.uint8).reshape(len(held), CLASSES)
                keep = partners(profiles, np.array([h[1] for h in held], np.int64), percent)
                if keep.any():
                    keep |= np.array([h[0] == key for h in held])
                found = [h[:2] for h, k in zip(held, keep.tolist()) if k]
            node, size = zip(*found) if found else ((), ())
            columns = [pa.array(node, pa.int64()), pa.array(size, pa.int64())]
            columns.append(pa.array([key] * len(found), pa.int64()))
            return pa.RecordBatch.from_arrays(columns, ["node", "n", "pivot"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[3] != key:
                    if held:
                        yield survivors()
                    key, held = row[3], []
                held.append(row[:3])
        if held:
            yield survivors()

    sizes = member.groupBy("pivot").agg(F.count("*").alias("members"))
    large = stored(sizes.filter(F.col("members") > COMPARED).select("pivot"), "large-pivots")
    # a large region is not compared here, so its members need no profile and meet in no task
    side = F.broadcast(large) if has_at_most(large, SENT_PIVOTS) else large
    passed = member.join(side, "pivot", "left_semi").select("node", "n", "pivot")
    small = member.join(side, "pivot", "left_anti")
    known = small.join(nodes.select("node", "profile"), "node").select("node", "n", "profile", "pivot")
    dealt = known.repartition(partitions, "pivot").sortWithinPartitions("pivot")
    return dealt.mapInArrow(check, "node long, n long, pivot long").unionByName(passed)


def regions(nodes: DataFrame) -> DataFrame:
    """``node, n, pivot``: the regions that a text belongs to. Cells of a single text have none."""
    packed = F.shiftleft(F.lit(255).cast("long") - F.col("central"), NODE_BITS).bitwiseOR(F.col("node"))
    seeds = nodes.select("node", "n", packed.alias("packed"), F.explode("prefix").alias("seed"))
    cells = seeds.groupBy("seed").agg(F.min("packed").alias("best"), F.count("*").alias("members"))
    pivot = F.col("best").bitwiseAND((1 << NODE_BITS) - 1)
    cells = cells.filter("members > 1").select("seed", pivot.alias("pivot"))
    return seeds.select("node", "n", "seed").join(cells, "seed").select("node", "n", "pivot").distinct()


def _linked(common: np.ndarray, own: int, sizes: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (own + sizes - common)


class Forest:
    """Union-find that keeps the edges that joined two trees."""

    def __init__(self, size: int):
        self.parent = list(range(size))
        self.edges: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.parent[x] = y
            self.edges.append((a, b))


def join_region(
    sets: list[np.ndarray], percent: int, first: int = 0, seekers: np.ndarray | None = None
) -> list[tuple[int, int]]:
    """Spanning edges of all links that a text of ``seekers`` (default: all texts) has within a region.

    ``first`` is the pivot from which all distances are measured.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    _, places = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    forest = Forest(len(sets))
    mark = np.zeros(int(places.max()) + 1, bool)

    def common(own: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        mark[own] = True
        found = np.add.reduceat(mark[flat], starts, dtype=np.int64)
        mark[own] = False
        return found

    pivot = places[ends[first] - sizes[first] : ends[first]]
    shared = common(pivot, places, ends - sizes)
    near = _linked(shared, int(sizes[first]), sizes, percent)
    distance = 1 - shared / (sizes[first] + sizes - shared)
    seek = np.ones(len(sets), bool) if seekers is None else seekers.copy()
    if seekers is None:
        # links among those that the pivot links already join nothing
        for x in np.flatnonzero(near):
            forest.join(int(x), first)
        seek &= ~near
    if not seek.any():
        return forest.edges
    # by distance to the pivot, so that a window is a slice
    order = np.argsort(distance, kind="stable")
    rank_distance = distance[order]
    flat = np.concatenate([places[ends[x] - sizes[x] : ends[x]] for x in order])
    own_sizes = sizes[order]
    own_ends = np.cumsum(own_sizes)
    reach = 1 - percent / 100 + 1e-9
    for x in np.flatnonzero(seek).tolist():
        low = int(np.searchsorted(rank_distance, distance[x] - reach))
        high = int(np.searchsorted(rank_distance, distance[x] + reach, side="right"))
        begin = int(own_ends[low] - own_sizes[low])
        starts = own_ends[low:high] - own_sizes[low:high] - begin
        mine = places[ends[x] - sizes[x] : ends[x]]
        shared = common(mine, flat[begin : own_ends[high - 1]], starts)
        for y in order[low:high][_linked(shared, len(mine), own_sizes[low:high], percent)].tolist():
            forest.join(x, y)
    return forest.edges


EDGES = "a long, b long"


def _joined(rows: DataFrame, keys: list[str], percent: int, partitions: int) -> DataFrame:
    """Spanning edges of every group of ``keys``; a group is one region or two blocks of one."""

    def groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray, bool]] = []
        seen: set[tuple[int, bool]] = set()
        key = None

        def flush() -> tuple[list[int], list[int]]:
            if len(held) < 2:
                return [], []
            node = [h[0] for h in held]
            seek = np.array([h[2] for h in held])
            first = node.index(key[0]) if key[0] in node else 0
            found = join_region([h[1] for h in held], percent, first, None if seek.all() else seek)
            return [node[a] for a, _ in found], [node[b] for _, b in found]

        for batch in batches:
            values, bounds = flat_list(batch.column(len(keys) + 1))
            values = values.copy()
            own = list(zip(*(batch.column(k).to_pylist() for k in range(len(keys)))))
            nodes = batch.column(len(keys)).to_pylist()
            seeks = batch.column(len(keys) + 2).to_pylist()
            a, b = [], []
            for k, this in enumerate(own):
                if this != key:
                    if held:
                        more = flush()
                        a += more[0]
                        b += more[1]
                    held, seen, key = [], set(), this
                # a repeated row may have sent its set from several tasks
                if (nodes[k], seeks[k]) not in seen:
                    seen.add((nodes[k], seeks[k]))
                    held.append((nodes[k], values[bounds[k] : bounds[k + 1]], seeks[k]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        if held:
            a, b = flush()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    dealt = rows.select(*keys, "node", "items", "seek").repartition(partitions, *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(groups, EDGES)


def _star(members: DataFrame, percent: int) -> DataFrame:
    """``members`` of large regions with ``linked``, whether the pivot links them."""
    pivots = members.filter("node = pivot").select("pivot", F.col("items").alias("centre")).dropDuplicates(["pivot"])
    common = F.size(F.array_intersect("items", "centre"))
    linked = 100 * common >= percent * (F.size("items") + F.size("centre") - common)
    return members.join(pivots, "pivot").withColumn("linked", linked).drop("centre")


def links(docs: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """Spanning edges ``a``, ``b`` between nodes over all links."""
    partitions = input_partitions(docs)
    member = stored(windowed(stored(regions(nodes), "cells"), nodes, percent, partitions), "regions")
    weight = member.groupBy("pivot").agg(F.sum("n").alias("items"), F.count("*").alias("members"))
    weight = weight.select("pivot", F.ceil(F.col("items") / REGION_ITEMS).cast("int").alias("blocks"))
    wanted = member.join(weight, "pivot").groupBy("node").agg(
        F.collect_list(F.struct("pivot", "blocks")).alias("regions")
    )
    wanted = stored(
        wanted.join(nodes, "node").select(
            "node", "regions", "digest", F.col("one.doc_id").alias("_doc_id"), F.col("one.mark").alias("_mark")
        ),
        "wanted",
    )
    side = F.broadcast(wanted) if has_at_most(wanted, SENT_DOCS) else wanted
    # by id and text, as many texts may have one id or none
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("mark") == F.col("_mark"))
    own = docs.select("doc_id", "text", _mark()).join(side, same)

    def shingled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for block in text_blocks(batches, "text", BLOCK):
            sets = list(shingle_sets(block.column(0), words))
            keep = []
            for k, (node, digest) in enumerate(zip(block.column(1).to_pylist(), block.column(2).to_pylist())):
                # a repeated row names the same node again; the digest tells texts of one mark apart
                if node not in sent and _digest(sets[k]) == digest:
                    sent.add(node)
                    keep.append(k)
            ends = np.cumsum([0, *(len(sets[k]) for k in keep)])
            flat = np.concatenate([sets[k] for k in keep]) if keep else np.zeros(0, np.int64)
            rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [block.column(1).take(rows), block.column(3).take(rows), list_column(flat, ends, pa.int64())],
                ["node", "regions", "items"],
            )

    schema = T.StructType([wanted.schema["node"], wanted.schema["regions"]])
    sets = own.select("text", "node", "digest", "regions").mapInArrow(
        shingled, schema.add("items", T.ArrayType(T.LongType()))
    )
    rows = sets.select("node", "items", F.inline("regions"))
    small = rows.filter("blocks = 1").withColumn("seek", F.lit(True))
    found = _joined(small, ["pivot"], percent, partitions)
    if no_rows(weight.filter("blocks > 1")):
        return found
    large = stored(rows.filter("blocks > 1"), "large-regions")
    star = stored(_star(large, percent), "stars")
    spokes = star.filter("linked AND node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    seekers = star.filter("NOT linked").select("pivot", block.alias("i"), F.explode(every).alias("j"), "node", "items")
    busy = star.filter("NOT linked").select("pivot", block.alias("i")).distinct()
    others = star.select("pivot", "node", "items", block.alias("j")).join(busy, "pivot")
    grid = seekers.withColumn("seek", F.lit(True)).unionByName(others.withColumn("seek", F.lit(False)))
    return found.union(spokes).union(_joined(grid, ["pivot", "i", "j"], percent, partitions))


def _classified(docs: DataFrame, words: int, percent: int, name: Column) -> DataFrame:
    """Per document ``doc_id, n, digest``, the columns beside its text, and ``least``, the smallest ``name`` linked to it.

    ``least`` is null where the text has no words.
    """
    more = [c for c in docs.columns if c not in ("doc_id", "text")]
    held = stored(prefixes(docs.withColumn("mark", _mark()), words, percent), "prefixes")
    nodes = (
        held.filter("n > 0")
        .groupBy("digest")
        .agg(
            F.min(F.struct("doc_id", "mark")).alias("one"),
            F.first("n").alias("n"),
            F.first("prefix").alias("prefix"),
            F.first("central").alias("central"),
            F.first("profile").alias("profile"),
            F.min(name).alias("name"),
        )
        .withColumn("node", F.monotonically_increasing_id())
    )
    nodes = stored(nodes, "nodes")
    joined = components(links(docs, nodes, words, percent))
    named = nodes.join(joined, "node", "left").select(
        "digest", "name", F.coalesce("component", "node").alias("component")
    )
    least = named.groupBy("component").agg(F.min("name").alias("least"))
    classes = stored(named.join(least, "component").select("digest", "least"), "classes")
    return held.select("doc_id", "n", "digest", *more).join(classes, "digest", "left")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, digest``.

    Documents link when their sets of ``words``-word shingles have a Jaccard
    similarity of ``percent`` or more; ``component_id`` is the smallest
    ``doc_id`` reachable by links. Texts without words have no shingle and link
    with nothing. A null ``doc_id`` never names a component that has another
    one. Repeated ids may stand for different texts. Columns beside ``doc_id``
    and ``text`` are not read; an empty table gives no rows.
    """
    found = _classified(docs.select("doc_id", "text"), words, percent, F.col("doc_id"))
    return found.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"),
        "digest",
    )


def keep_distinct(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that are the first of their near duplicates, with all their columns.

    First is the smallest ``doc_id``, null after all others, then the smallest
    SHA-256 of the text. Ids may be null or stand for several texts. Only rows
    that share both ``doc_id`` and text stand or fall together; ``keep_exact``
    leaves one of them.
    """
    sha = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    name = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "sha")
    found = _classified(docs.select("doc_id", "text", sha.alias("sha")), words, percent, name)
    gone = found.filter((F.col("n") > 0) & (name != F.col("least")))
    gone = gone.select(F.col("doc_id").alias("_doc_id"), F.col("sha").alias("_sha"))
    gone = stored(gone.distinct(), "near-duplicates")
    own = packed(docs, "doc_id", sha.alias("sha"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("sha") == F.col("_sha"))
    return own.join(gone, same, "left_anti").select("row.*")
