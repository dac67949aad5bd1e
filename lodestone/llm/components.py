"""Connected components of an edge list by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.tables import stored


def _state(edges: DataFrame) -> tuple:
    # a sum of decimals, as a sum of longs would overflow
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row.n, row.s


def _star(pairs: DataFrame, keep: str) -> tuple[DataFrame, DataFrame]:
    """Ties every neighbour that ``keep`` admits to the smallest node around ``a``; those smallest nodes."""
    least = pairs.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    tied = pairs.join(least, "a").filter(keep).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied, least


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, its smallest reachable node, for every node of ``edges`` (``a``, ``b``).

    Large star and small star take turns until nothing changes, a number of
    rounds that grows with the logarithm of the longest chain. Every round is
    stored, and no node's neighbours are ever held together.
    """
    edges = stored(edges.filter("a <> b").distinct(), "edges")
    before = _state(edges)
    while before[0]:
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        large, _ = _star(both, "b > a")
        large = large.filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        small, least = _star(down, "b <> m")
        roots = least.filter("a <> m").select("a", F.col("m").alias("b"))
        edges = stored(small.union(roots).distinct(), "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    tied = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return tied.union(edges.select("b", "b").distinct())
