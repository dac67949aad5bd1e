"""Row numbers, running totals and top-k that hold up when one group is huge.

A window over a whole group sorts that group in one task. The functions here
cut a group into slices instead: each slice is numbered on its own and shifted
by the totals of the slices before it, which come from a map-side aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators.joins import join_same

SALTS = 32


def top_k(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column | str],
    k: int,
    rank: str = "rank",
    salts: int = SALTS,
) -> DataFrame:
    """The first ``k`` rows of each group, ranked from 1.

    ``order`` must be a total order within the group. Every task first keeps
    its own ``k`` rows per group; these meet in ``salts`` parts of each group
    and only then as a whole, so no task sees all of a hot group. The salt is
    the number of the task, which leaves the first step as selective as it is
    without salt; the result does not depend on it.
    """
    group = list(group)
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    if salts > 1:
        df = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        part = W.partitionBy(*group, "_salt").orderBy(*order)
        df = df.withColumn(rank, F.row_number().over(part)).where(F.col(rank) <= k)
        df = df.drop("_salt", rank)
    whole = W.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(whole)).where(F.col(rank) <= k)


def running_offsets(
    df: DataFrame, group: Sequence[str], slice_by: Column, amount: Column
) -> DataFrame:
    """Per group and slice, the total of ``amount`` in all earlier slices.

    Columns: the group, ``_slice``, ``_before``. Only the per-slice totals,
    one small row each, meet in one task.
    """
    group = list(group)
    totals = (
        df.select(*group, slice_by.alias("_slice"), amount.alias("_amount"))
        .groupBy(*group, "_slice")
        .agg(F.sum("_amount").alias("_total"))
    )
    earlier = W.partitionBy(*group).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_total").over(earlier), F.lit(0))
    return totals.select(*group, "_slice", before.alias("_before"))


def running_total(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    slice_by: Column,
    amount: Column,
    name: str,
) -> DataFrame:
    """Adds ``name``: the total of ``amount`` over the rows before this one.

    ``slice_by`` must never fall as ``order`` rises; it bounds what one task
    sorts (for a dense line number: the number divided by a slice length).
    """
    group = list(group)
    offsets = running_offsets(df, group, slice_by, amount)
    earlier = (
        W.partitionBy(*group, "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    )
    sliced = df.withColumn("_slice", slice_by).withColumn(
        "_inside", F.coalesce(F.sum(amount).over(earlier), F.lit(0))
    )
    return (
        join_same(sliced, offsets, [*group, "_slice"])
        .withColumn(name, (F.col("_before") + F.col("_inside")).cast("long"))
        .drop("_slice", "_before", "_inside")
    )


def numbered(
    df: DataFrame, group: Sequence[str], order: Sequence[str], slice_by: Column, name: str = "n"
) -> DataFrame:
    """Adds ``name``: the 0-based position of the row in its group."""
    return running_total(df, group, order, slice_by, F.lit(1), name)
