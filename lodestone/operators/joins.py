"""Joins on keys that may be null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_same(
    left: DataFrame, right: DataFrame, keys: Sequence[str], small: bool = False, how: str = "inner"
) -> DataFrame:
    """Join on equal keys, null equal to null; the keys come from the left side.

    ``small``: the right side was checked to be small enough for every task.
    """
    keys = list(keys)
    rest = [c for c in right.columns if c not in keys]
    renamed = right.select(*[F.col(k).alias(f"_same_{i}") for i, k in enumerate(keys)], *rest)
    if small:
        renamed = F.broadcast(renamed)
    same = F.lit(True)
    for i, key in enumerate(keys):
        same = same & left[key].eqNullSafe(renamed[f"_same_{i}"])
    return left.join(renamed, same, how).drop(*[f"_same_{i}" for i in range(len(keys))])
