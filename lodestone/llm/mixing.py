"""Mixing sources to target weights: exact block quotas, dealt to output shards by a splitting tree.

The documents of a source are put in a pseudo-random order by a digest and cut
into blocks. A source's target is met by whole passes over its blocks and a last
pass that ends inside a block. The taken blocks of all sources are dealt to
output shards by a tree: at every node the block counts of the sources are split
between the two halves of its shards by a multivariate hypergeometric draw, as
if all blocks had been shuffled. A shard then holds disjoint ranges of each
source's permuted blocks, and its rows are shuffled within it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.tables import packed, stored
from lodestone.session import has_at_most

#: Documents of a block, about.
BLOCK_DOCS = 1024
#: Words of an output shard, about.
SHARD_WORDS = 1 << 21
WEIGHTS = (3, 1, 2)
#: Words of the mix for every word of the input, and the most that a source gives of its own.
SHARE = 1.5
MOST = 2
SEED = 17
#: Sources up to which their table is sent to the tasks; beyond it both sides are dealt by source.
SENT_SOURCES = 10_000


def size_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def mark_of(seed: int) -> Column:
    """The digest that orders the documents of a source."""
    own = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
    return F.md5(F.concat_ws("|", F.lit(str(seed)), name, own).cast("binary"))


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``sid, source, source_size, target`` from ``source`` and ``source_size``.

    Weights repeat over the sources by code point, null last. No target exceeds
    ``most`` times its source; what a source cannot give is shared by weight
    among the others.
    """
    everything = W.partitionBy()
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    rows = sources.withColumn("sid", F.row_number().over(by_name))
    rows = rows.withColumn("weight", F.get(cycle, (F.col("sid") - 1) % len(weights)))
    rows = rows.withColumn("cap", F.col("source_size") * most)
    rows = rows.withColumn("want", F.sum("source_size").over(everything) * F.lit(share))
    # fullest first: a source is full when even its share of what the fuller ones leave exceeds its cap
    fullest = W.orderBy(F.col("cap") / F.col("weight"), "sid")
    before = F.coalesce(F.sum("cap").over(fullest.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ahead = F.sum("weight").over(fullest.rowsBetween(0, W.unboundedFollowing))
    full = (F.col("want") - before) / ahead >= F.col("cap") / F.col("weight")
    rows = rows.withColumn("full", full)
    left = F.col("want") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(everything)
    open_weight = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(everything)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(left * F.col("weight") / open_weight)
    return rows.select("sid", "source", "source_size", target.alias("target"))


def shard_quotas(quotas: Sequence[int], shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """How many blocks of every source a shard gets, and how many go to the shards before it.

    Follows the splitting tree from the root to the shard. The draw at a node
    depends on the seed and the node alone, so all shards agree on it.
    """
    counts, before = np.array(quotas, np.int64), np.zeros(len(quotas), np.int64)
    low, high = 0, shards
    while high - low > 1:
        middle = (low + high) // 2
        total = int(counts.sum())
        room = total * (middle - low) // (high - low)
        draw = np.random.Generator(np.random.PCG64([seed, low, high]))
        left = draw.multivariate_hypergeometric(counts, room, method="marginals")
        if shard < middle:
            counts, high = left, middle
        else:
            counts, before, low = counts - left, before + left, middle
    return counts, before


class Mix:
    """The plan of a mix over ``docs``: targets, blocks and shards."""

    def __init__(
        self,
        docs: DataFrame,
        weights: Sequence[int] = WEIGHTS,
        share: float = SHARE,
        most: int = MOST,
        whole: bool = False,
        seed: int = SEED,
        block_docs: int = BLOCK_DOCS,
        shard_words: int = SHARD_WORDS,
    ):
        self.docs = packed(docs, "doc_id", "text", "source")
        self.whole, self.seed = whole, seed
        parts = self.docs.groupBy("source").agg(F.ceil(F.count("*") / block_docs).cast("long").alias("parts"))
        parts = parts.withColumn("sid", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
        self.parts = stored(
            parts.select(F.col("source").alias("_source"), F.col("sid").alias("_sid"), F.col("parts").alias("_parts")),
            "mix-sources",
        )
        blocks = stored(
            self.numbered().groupBy("_sid", "_block").agg(F.sum("_size").alias("words")), "mix-blocks"
        )
        sizes = blocks.groupBy("_sid").agg(F.sum("words").alias("source_size"))
        named = sizes.join(self.parts, "_sid").select(F.col("_source").alias("source"), "source_size")
        self.targets = stored(targets(named, weights, share, most), "mix-targets")
        # whole passes, then words of the last pass, block after block
        passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
        order = W.partitionBy("_sid").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
        goal = self.targets.select(F.col("sid").alias("_sid"), "source_size", "target", passes.cast("int").alias("passes"))
        blocks = blocks.join(goal, "_sid").withColumn("before", F.coalesce(F.sum("words").over(order), F.lit(0)))
        rest = F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long")
        blocks = blocks.withColumn("rest", rest)
        blocks = blocks.withColumn(
            "last", F.greatest(F.least(F.col("rest") - F.col("before"), F.col("words")), F.lit(0))
        )
        taken = F.col("passes") + (F.col("last") > 0).cast("int")
        blocks = blocks.withColumn("taken", taken)
        self.blocks = self.dealt(stored(blocks, "mix-plan"), shard_words)

    def numbered(self) -> DataFrame:
        """The documents with their source number, block, size and mark."""
        side = F.broadcast(self.parts) if has_at_most(self.parts, SENT_SOURCES) else self.parts
        own = self.docs.join(side, F.col("source").eqNullSafe(F.col("_source")))
        own = own.withColumn("_size", size_of(F.col("text"))).withColumn("_mark", mark_of(self.seed))
        place = F.conv(F.substring("_mark", 1, 8), 16, 10).cast("long")
        block = F.shiftright(place * F.col("_parts"), 32)
        return own.withColumn("_block", block).drop("_source", "_parts")

    def dealt(self, blocks: DataFrame, shard_words: int) -> DataFrame:
        """``blocks`` with ``shards``, the shard of each pass over the block."""
        spark = blocks.sparkSession
        totals = blocks.groupBy("_sid").agg(F.sum("taken").alias("n"), F.first("target").alias("target"))
        totals = sorted(totals.collect(), key=lambda r: r["_sid"])  # one row per source
        quotas = [int(r.n) for r in totals]
        self.shards = max(1, round(sum(r.target for r in totals) / shard_words))
        shards, seed = self.shards, self.seed

        def ranges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard in batch.column(0).to_pylist():
                    counts, before = shard_quotas(quotas, shards, shard, seed)
                    sid = np.repeat(np.arange(len(counts)) + 1, counts)
                    first = np.repeat(np.cumsum(counts) - counts, counts)
                    rank = np.arange(len(sid)) - first + np.repeat(before, counts)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(sid, pa.int32()), pa.array(rank, pa.int64()), pa.array(np.full(len(sid), shard), pa.int64())],
                        ["_sid", "rank", "shard"],
                    )

        owners = spark.range(shards).mapInArrow(ranges, "_sid int, rank long, shard long")
        taken = blocks.filter("taken > 0").select(
            "_sid", "_block", F.explode(F.sequence(F.lit(1), F.col("taken"))).alias("pass")
        )
        permuted = W.partitionBy("_sid").orderBy(F.xxhash64(F.lit(seed), "_sid", "_block", "pass"), "_block", "pass")
        taken = taken.withColumn("rank", (F.row_number().over(permuted) - 1).cast("long"))
        homes = taken.join(owners, ["_sid", "rank"]).groupBy("_sid", "_block").agg(
            F.transform(F.sort_array(F.collect_list(F.struct("pass", "shard"))), lambda x: x["shard"]).alias("shards")
        )
        return stored(blocks.join(homes, ["_sid", "_block"], "left"), "mix-shards")

    def placed(self) -> DataFrame:
        """All rows of ``docs`` as ``row``, with ``_size``, ``_source_size``, ``_target`` and ``_placements``.

        A placement is one time that the mix takes the document: ``shard``,
        ``words`` and ``place``, by which the rows of a shard are shuffled. Only
        the documents of the block in which a source's last pass ends are
        ordered; all others need nothing but their block. That document is cut
        at a word, or with ``whole`` taken or left as a whole.
        """
        own = self.numbered().join(
            self.blocks.select("_sid", "_block", "words", "before", "last", "passes", "taken", "shards", "source_size", "target"),
            ["_sid", "_block"],
        )
        plain = own.filter("last = 0 OR last = words").withColumn(
            "_part", F.when(F.col("last") > 0, F.col("_size")).otherwise(F.lit(0).cast("long"))
        )
        order = W.partitionBy("_sid", "_block").orderBy("_mark", "_size").rowsBetween(W.unboundedPreceding, -1)
        edge = own.filter("last > 0 AND last < words").withColumn("_start", F.coalesce(F.sum("_size").over(order), F.lit(0)))
        room = F.col("last") - F.col("_start")
        if self.whole:
            part = F.when(2 * room >= F.col("_size"), F.col("_size")).otherwise(0).cast("long")
        else:
            part = F.greatest(F.least(room, F.col("_size")), F.lit(0)).cast("long")
        every = plain.unionByName(edge.withColumn("_part", part).drop("_start"))
        words = F.transform(
            F.coalesce("shards", F.array().cast("array<bigint>")),
            lambda shard, i: F.struct(
                shard.alias("shard"),
                F.when(i < F.col("passes"), F.col("_size")).otherwise(F.col("_part")).alias("words"),
                F.xxhash64(F.lit(self.seed), F.col("_mark"), i).alias("place"),
            ),
        )
        return every.select(
            "row",
            "_size",
            F.col("source_size").alias("_source_size"),
            F.col("target").alias("_target"),
            F.filter(words, lambda p: p["words"] > 0).alias("_placements"),
        )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix with the columns of ``docs``, a row for every time a document is taken whole.

    Rows lie shard by shard, shuffled within. Documents without words are not
    part of a mix. An empty table gives an empty mix.
    """
    plan = Mix(docs, whole=True, **options)
    rows = plan.placed().select("row", F.inline("_placements"))
    return rows.repartition(plan.shards, "shard").sortWithinPartitions("shard", "place").select("row.*")


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken`` and ``shards``.

    ``taken`` counts the words the mix takes of the document, repeats included,
    at most ``most`` times ``size``. The order is by digest of id and text, so
    reruns agree; of equal rows it does not matter which one is cut. Null
    sources are a source of their own, null texts have size 0.
    """
    plan = Mix(docs.select("doc_id", "text", "source"), **options)
    return plan.placed().select(
        "row.doc_id",
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        F.aggregate("_placements", F.lit(0).cast("long"), lambda a, p: a + p["words"]).alias("taken"),
        F.transform("_placements", lambda p: p["shard"]).alias("shards"),
    )
