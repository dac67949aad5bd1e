import random

from pyspark.sql import functions as F

from lodestone.operators.joins import join_same
from lodestone.operators.ordering import numbered, running_total, top_k


def test_numbers_over_slices_of_a_hot_group(spark):
    rows = [("hot", i) for i in range(0, 900, 3)] + [("b", 5), ("b", 400), (None, 7), (None, None)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, o int")
    found = numbered(df, ["g"], ["o"], F.floor(F.col("o") / 50)).collect()
    assert len(found) == len(rows)
    by_group = {}
    for row in found:
        by_group.setdefault(row.g, []).append((row.n, row.o))
    assert sorted(by_group["hot"]) == [(i, 3 * i) for i in range(300)]
    assert sorted(by_group["b"]) == [(0, 5), (1, 400)]
    assert sorted(by_group[None], key=str) == [(0, None), (1, 7)]


def test_running_total(spark):
    df = spark.createDataFrame([(0, i, i + 1) for i in range(20)], "g int, o int, v int")
    found = running_total(df, ["g"], ["o"], F.floor(F.col("o") / 4), F.col("v"), "s")
    assert [r.s for r in found.orderBy("o").collect()] == [sum(range(1, i + 1)) for i in range(20)]


def test_top_k_with_ties(spark):
    rows = [(g, i % 7, i) for g in ("a", "b") for i in range(200)] + [("c", 1, 1)]
    df = spark.createDataFrame(rows, "g string, d int, k int").repartition(13)
    found = top_k(df, ["g"], ["d", "k"], 40).collect()
    for group in "abc":
        wanted = sorted((d, k) for g, d, k in rows if g == group)[:40]
        got = sorted((r["rank"], r.d, r.k) for r in found if r.g == group)
        assert got == [(i + 1, d, k) for i, (d, k) in enumerate(wanted)]


def test_join_same_matches_nulls(spark):
    left = spark.createDataFrame([(1, "a"), (None, "b"), (None, None)], "x int, y string")
    right = spark.createDataFrame([(None, "b", 5), (1, "z", 6), (None, None, 7)], "x int, y string, v int")
    for small in (True, False):
        found = join_same(left, right, ["x", "y"], small).collect()
        assert sorted((r.v, r.y or "") for r in found) == [(5, "b"), (7, "")]
