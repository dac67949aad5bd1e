"""How filters act together: survivors of every subset of filters, in every order of them.

A document becomes a 32-bit word, its truth table over the subsets of up to
five filters: bit ``S`` is set where it survives all filters of subset ``S``.
The words of a part and label are summed bit by bit with carry-save adders, so
that the survivors of all 32 subsets come from one pass; what any filter removes
at any place of any order is a difference of two of these counts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.quality import words
from lodestone.llm.tables import stored

#: Filters of a word of 32 bits at most.
MOST = 5


def text_failures(text: Column) -> dict[str, Column]:
    """Whether a text fails the filters A to D; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    own = words(text)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(own) < 200,
        "B": 100 * F.size(F.array_distinct(own)) < 50 * F.size(own),
        "C": 100 * capitals > 2 * F.length(text),
        "D": F.rlike(text, F.lit("[#$%&*|]")),
    }


def later_copies(rows: DataFrame) -> DataFrame:
    """``rows`` (with ``doc_id``, ``digest``) and ``copy``: a smaller ``doc_id`` has the same digest.

    Only a digest's smallest id comes back to the rows, and it meets them by id
    and digest together: however many copies a text has, they lie in as many
    places as they have ids. A row without id is no copy and makes none.
    """
    known = rows.filter("doc_id IS NOT NULL")
    first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("_first", F.lit(True))
    marked = known.join(first, ["doc_id", "digest"], "left").withColumn("copy", F.col("_first").isNull())
    unknown = rows.filter("doc_id IS NULL").withColumn("copy", F.lit(False))
    return marked.drop("_first").unionByName(unknown)


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with ``good`` and ``toxic``, false where no label of their ``doc_id`` says so."""
    marks = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    known = rows.filter("doc_id IS NOT NULL").join(marks, "doc_id", "left")
    unknown = rows.filter("doc_id IS NULL").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    return known.unionByName(unknown).fillna(False, ["good", "toxic"])


def survival_word(fails: int, filters: int) -> int:
    """The truth table of a text that fails the filters of the bits of ``fails``."""
    return sum(1 << subset for subset in range(1 << filters) if not subset & fails)


def bit_counts(values: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """How many ``values`` (32-bit words, sorted by ``group``) have each bit set, per group.

    Three words of one weight become their sum word of the same weight and their
    carry word of twice the weight; at most two words of a weight are left per
    group, and only these are taken apart.
    """
    totals = np.zeros((groups, 32), np.int64)
    weight = 1
    while len(values):
        carried: list[tuple[np.ndarray, np.ndarray]] = []
        while True:
            sizes = np.bincount(group, minlength=groups)
            at = np.arange(len(group)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            full = 3 * (sizes // 3)[group]
            head = np.flatnonzero((at % 3 == 0) & (at < full))
            if not len(head):
                break
            a, b, c = values[head], values[head + 1], values[head + 2]
            half = a ^ b
            carried.append((a & b | c & half, group[head]))
            rest = at >= full
            values = np.concatenate([half ^ c, values[rest]])
            group = np.concatenate([group[head], group[rest]])
            order = np.argsort(group, kind="stable")
            values, group = values[order], group[order]
        bits = values[:, None] >> np.arange(32, dtype=np.uint32) & 1
        np.add.at(totals, group, bits.astype(np.int64) * weight)
        weight *= 2
        values = np.concatenate([np.zeros(0, np.uint32), *[x for x, _ in carried]])
        group = np.concatenate([np.zeros(0, np.int64), *[g for _, g in carried]])
        order = np.argsort(group, kind="stable")
        values, group = values[order], group[order]
    return totals


def survivors(rows: DataFrame, filters: int) -> DataFrame:
    """Per ``part`` the arrays ``kept``, ``good``, ``toxic``: survivors of every subset of filters.

    ``rows`` hold ``part``, ``good``, ``toxic`` and ``fails``, a bit per filter.
    Batches are counted where they lie; one row per batch, part and label leaves
    a task, and those are summed before they move.
    """
    table = np.array([survival_word(fails, filters) for fails in range(1 << filters)], np.uint32)
    subsets = range(1 << filters)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(0).dictionary_encode()
            label = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            key = part.indices.to_numpy().astype(np.int64) * 4 + label
            held, group = np.unique(key, return_inverse=True)
            order = np.argsort(group, kind="stable")
            found = table[batch.column(2).to_numpy()[order]]
            totals = bit_counts(found, group[order], len(held))
            columns = [part.dictionary.take(pa.array(held // 4)), pa.array(held % 4, pa.int32())]
            columns += [pa.array(np.ascontiguousarray(totals[:, s])) for s in subsets]
            yield pa.RecordBatch.from_arrays(columns, ["part", "label", *[f"s{s}" for s in subsets]])

    label = F.col("good").cast("int") + 2 * F.col("toxic").cast("int")
    counts = rows.select("part", label.alias("label"), "fails").mapInArrow(
        count, "part string, label int, " + ", ".join(f"s{s} long" for s in subsets)
    )
    sums = counts.groupBy("part", "label").agg(*[F.sum(f"s{s}").alias(f"s{s}") for s in subsets])

    def over(which: str, s: int) -> Column:
        return F.coalesce(F.expr(f"sum(if({which}, s{s}, 0))"), F.lit(0))

    kinds = {"kept": "true", "good": "label & 1 = 1", "toxic": "label & 2 = 2"}
    return sums.groupBy("part").agg(
        *[F.array(*[over(which, s) for s in subsets]).alias(name) for name, which in kinds.items()]
    )


def order_report(counts: DataFrame, names: str) -> DataFrame:
    """The steps of every order of the filters ``names`` from the arrays of ``survivors``.

    One row per part, ``filter_order`` and ``step`` (from 1): ``kept`` after it,
    ``removed`` by it, ``redundant`` (failing its filter but removed earlier),
    ``unique_fails`` (failing its filter alone), ``good_lost``, ``toxic_lost``
    (labelled and removed), ``shapley`` (what its filter removes, summed over
    all orders).
    """
    n, every = len(names), (1 << len(names)) - 1
    steps = []
    for order in permutations(range(n)):
        before = 0
        for step, f in enumerate(order):
            steps.append(f"('{''.join(names[x] for x in order)}', {step + 1}, {f}, {before}, {before | 1 << f})")
            before |= 1 << f
    shares = []
    for f in range(n):
        terms = [
            f"{factorial(s.bit_count()) * factorial(n - 1 - s.bit_count())} * (kept[{s}] - kept[{s | 1 << f}])"
            for s in range(every + 1)
            if not s >> f & 1
        ]
        shares.append(" + ".join(terms))
    table = f"inline(array({', '.join('struct' + s for s in steps)})) AS (filter_order, step, f, before, after)"
    laid = counts.selectExpr("*", f"array({', '.join(shares)}) AS share").selectExpr("*", table)
    return laid.selectExpr(
        "part",
        "filter_order",
        "step",
        "kept[after] AS kept",
        "kept[before] - kept[after] AS removed",
        "kept[0] - kept[shiftleft(1, f)] - (kept[before] - kept[after]) AS redundant",
        f"kept[{every} - shiftleft(1, f)] - kept[{every}] AS unique_fails",
        "good[before] - good[after] AS good_lost",
        "toxic[before] - toxic[after] AS toxic_lost",
        "share[f] AS shapley",
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``order_report`` of the filters A to D of ``text_failures`` and E, a copy of a smaller ``doc_id``'s text.

    Parts are the values of ``source``, null as the empty string. A null text is
    empty; every row counts, repeated rows each; a row without ``doc_id`` is no
    copy and has no label; several labels of one id count where one of them says
    so. Texts are equal where their SHA-256 is. An empty table has no part and
    so no row. Other columns are not read.
    """
    texts = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    bits = [fails.cast("int") * (1 << k) for k, fails in enumerate(text_failures(F.col("text")).values())]
    rows = texts.select(
        "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), sum(bits[1:], bits[0]).alias("fails")
    )
    rows = later_copies(stored(rows, "audited"))
    fails = F.col("fails") + F.col("copy").cast("int") * 16
    rows = rows.select("doc_id", "part", fails.alias("fails"))
    return order_report(survivors(labelled(rows, labels), MOST), "ABCDE")
