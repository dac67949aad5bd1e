import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import blocks as B
from lodestone.operators import postings as X
from lodestone.session import scratch_path

RNG = random.Random(4)
WORDS = [f"w{k}" for k in range(300)]


def text(k):
    common = ["the"] * RNG.randrange(1, 6) + ["of"] * RNG.randrange(4)
    return " ".join(common + [WORDS[min(int(RNG.expovariate(0.03)), 299)] for _ in range(RNG.randrange(3, 40))])


ROWS = [(k, text(k)) for k in range(3000)] + [(3000, None), (3001, ""), (3002, "-- !")]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "row_key long, text string").repartition(4).cache()


@pytest.fixture(scope="module")
def index(spark, table):
    rows = B.numbered_rows(table, ["row_key"], 1000)
    texts = B.text_rows(table, rows, "text", ["row_key"])
    folder = scratch_path(spark, "blocks")
    B.blocks_of(texts, 5, 16).write.partitionBy("bucket").parquet(folder)
    blocks = spark.read.parquet(folder)
    return rows, blocks, B.text_totals(table.where("text IS NOT NULL"), blocks)


def test_numbers_in_bytes():
    values = np.array([0, 1, 127, 128, 300, 2**14 - 1, 2**14, 2**31, 2**40, 2**62])
    data, sizes = B.packed_numbers(values)
    assert (B.unpacked_numbers(data) == values).all() and sizes[:4].tolist() == [1, 1, 1, 2]
    assert len(B.unpacked_numbers(B.packed_numbers(np.zeros(0, np.int64))[0])) == 0


def test_blocks_hold_the_postings(spark, table, index):
    rows, blocks, totals = index
    numbers = [r.row_no for r in rows.collect()]
    assert sorted(numbers) == list(range(1000, 1000 + len(ROWS)))
    found = B.expanded(blocks, places=True).join(rows, "row_no")
    names = "row_key term tf row_terms positions".split()
    shape = lambda df: sorted((r.row_key, r.term, r.tf, r.row_terms, list(r.positions)) for r in df.select(*names).collect())
    assert shape(found) == shape(X.postings(table, "text"))
    assert blocks.agg(F.max("n")).first()[0] <= 16
    stats = lambda df: sorted(map(tuple, df.collect()))
    assert stats(B.block_stats(blocks)) == stats(X.term_stats(X.postings(table, "text")))
    assert tuple(totals.first()) == (3002, sum(len(t.split()) for _, t in ROWS[:3000]))


def test_postings_get_their_keys_without_a_shuffle_of_postings(spark, table, index, monkeypatch):
    rows, blocks, _ = index
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    monkeypatch.setattr(B, "KEYED_POSTINGS", 50)
    names = "row_key term tf row_terms positions".split()
    shape = lambda df: sorted((r.row_key, r.term, r.tf, r.row_terms, list(r.positions)) for r in df.select(*names).collect())
    found = B.keyed_postings(blocks, rows, ["row_key"], 64)
    assert shape(found) == shape(X.postings(table, "text"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hash") == 1
    some = rows.where("row_key % 3 = 0")
    assert shape(B.keyed_postings(blocks, some, ["row_key"], 64)) == shape(X.postings(table.where("row_key % 3 = 0"), "text"))


def test_a_task_blocks_so_many_bytes_of_text(spark, table, index, monkeypatch):
    rows, blocks, _ = index
    monkeypatch.setattr(B, "BLOCKED_BYTES", 5000)
    made = B.blocks_of(B.text_rows(table, rows, "text", ["row_key"]), block=16)
    assert made.rdd.getNumPartitions() == 1 + sum(len(t or "") for _, t in ROWS) // 5000
    held = made.cache()
    assert held.select(F.spark_partition_id()).distinct().count() > 8
    stats = lambda df: sorted(map(tuple, df.collect()))
    assert stats(B.block_stats(held)) == stats(B.block_stats(blocks))


QUERIES = [(1, "the w120"), (2, "the of"), (3, "w3 w250 of nothing"), (4, "nothing"), (5, "w1 w2 w3 w4 the of the"), (6, ""), (7, None), (8, "w299")]


@pytest.mark.parametrize("k", [1, 7, 5000])
def test_ranking_equals_full_scoring(spark, table, index, k):
    rows, blocks, totals = index
    queries = spark.createDataFrame(QUERIES, "query_id int, text string")
    counts = X.term_counts(table, "text")
    stats = X.term_stats(counts)
    wanted = X.keyword_search(counts, stats, X.corpus_stats(table, "text", stats), queries, k)
    shape = lambda df: sorted((r.query_id, r["rank"], r.row_key, round(r.score, 8)) for r in df.collect())
    assert shape(B.search_blocks(blocks, totals, rows, queries, k, ["row_key"])) == shape(wanted)


@pytest.mark.parametrize("asked,k,share", [("the of w200 w220", 3, 2), ("the of w285", 1, 6)])
def test_common_words_are_hardly_expanded(spark, index, asked, k, share):
    """Postings expanded, out of all that the words of the query have."""
    rows, blocks, totals = index
    queries = spark.createDataFrame([(1, asked)], "query_id int, text string")
    ranking = B.rank_blocks(blocks, totals, queries, k)
    size = lambda df: df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    read, there = size(ranking.read), size(ranking.directory)
    assert there > 4000 and 0 < read < there / share


def test_only_wanted_buckets_are_read(spark, index):
    rows, blocks, totals = index
    queries = spark.createDataFrame([(1, "the w200")], "query_id int, text string")
    plan = B.rank_blocks(blocks, totals, queries, 3).best._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan or "PartitionFilters: [isnotnull(bucket" in plan


def test_no_texts(spark):
    none = spark.createDataFrame([], "row_key long, text string")
    rows = B.numbered_rows(none, ["row_key"])
    blocks = B.blocks_of(B.text_rows(none, rows, "text", ["row_key"]))
    assert blocks.count() == 0 and tuple(B.text_totals(none, blocks).first()) == (0, 0)
    queries = spark.createDataFrame(QUERIES, "query_id int, text string")
    assert B.search_blocks(blocks, B.text_totals(none, blocks), rows, queries, 3, ["row_key"]).count() == 0


def test_long_queries_keep_few_rows(spark, index):
    """Each of many words names many rows; no more than the best of a stretch leave their task."""
    rows, blocks, totals = index
    asked = " ".join(["the of", *WORDS[:60]])
    queries = spark.createDataFrame([(1, asked), (2, asked + " w70")], "query_id int, text string")
    assert B.rank_blocks(blocks, totals, queries, 3).best.count() < 100


def test_queries_in_several_passes(spark, table, index, monkeypatch):
    rows, blocks, totals = index
    queries = spark.createDataFrame(QUERIES, "query_id int, text string")
    shape = lambda df: sorted((r.query_id, r["rank"], r.row_key, round(r.score, 8)) for r in df.collect())
    wanted = shape(B.search_blocks(blocks, totals, rows, queries, 7, ["row_key"]))
    monkeypatch.setattr(B, "QUERY_TERMS", 4)
    assert shape(B.search_blocks(blocks, totals, rows, queries, 7, ["row_key"])) == wanted


def test_rows_numbered_where_they_are(spark, table):
    placed = B.placed_rows(table, 1000)
    assert sorted(r.row_no for r in placed.collect()) == list(range(1000, 1000 + len(ROWS)))
    assert "SortMergeJoin" not in placed._jdf.queryExecution().toString()
    blocks = B.blocks_of(placed.select("row_no", "text"), 3, 16)
    names = "row_key term tf row_terms positions".split()
    shape = lambda df: sorted((r.row_key, r.term, r.tf, r.row_terms, list(r.positions)) for r in df.select(*names).collect())
    found = B.expanded(blocks, places=True).join(placed.select("row_key", "row_no"), "row_no")
    assert shape(found) == shape(X.postings(table, "text"))
    # what is shuffled are pieces of many postings, dealt without a look at all of them first
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "hashpartitioning" in plan


def test_a_task_writes_to_few_buckets(spark):
    texts = spark.range(400).select(
        F.col("id").alias("row_no"), F.concat_ws(" ", *[F.concat(F.lit(f"w{i}x"), "id") for i in range(20)]).alias("text")
    )
    made = B.blocks_of(texts, tasks=16).select(F.spark_partition_id().alias("task"), "bucket")
    counts = made.groupBy("task").agg(F.count_distinct("bucket").alias("n"), F.count("*").alias("rows")).collect()
    assert len(counts) == 16 and sum(c.n for c in counts) <= B.BUCKETS + 16
    assert max(c.rows for c in counts) < 2 * 8000 / 16


def test_packed_numbers_of_all_widths():
    rng = np.random.default_rng(0)
    for bits in range(1, 63):
        values = np.where(rng.random(200) < 0.7, rng.integers(0, 100, 200), rng.integers(0, 1 << bits, 200))
        data, sizes = B.packed_numbers(values)
        assert sizes.tolist() == [max(1, -(-int(v).bit_length() // 7)) for v in values]
        assert (B.unpacked_numbers(data) == values).all()


def sent(plan):
    """What stands below the broadcasts of a plan, a text for each."""
    lines, found = plan.splitlines(), []
    depth = lambda line: len(line) - len(line.lstrip(" +-:*|"))
    for at, line in enumerate(lines):
        if "BroadcastExchange" in line:
            past = next((k for k in range(at + 1, len(lines)) if depth(lines[k]) <= depth(line)), len(lines))
            found.append("\n".join(lines[at:past]))
    return found


def test_what_grows_with_the_table_is_not_sent(spark, table, index, monkeypatch):
    """Rows and blocks take few bytes in files; the driver would have to hold them unpacked."""
    rows, blocks, totals = index
    rows = B.stored(rows, "numbers")
    queries = spark.createDataFrame(QUERIES, "query_id int, text string")
    shape = lambda df: sorted((r.query_id, r["rank"], r.row_key, round(r.score, 8)) for r in df.collect())
    found = B.search_blocks(blocks, totals, rows, queries, 7, ["row_key"])
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert not any("row_key#" in part for part in sent(plan(found)))
    plans, real = {}, B.stored
    monkeypatch.setattr(B, "stored", lambda df, name: plans.__setitem__(name, plan(df)) or real(df, name))
    monkeypatch.setattr(B, "SENT_ROWS", 4)
    many = B.search_blocks(blocks, totals, rows, queries, 7, ["row_key"])
    assert shape(many) == shape(found)
    assert not sent(plan(many))
    assert not any("first#" in part for name in ("looked-up", "best-rows") for part in sent(plans[name]))
