import numpy as np
import pyarrow as pa
import pytest

from lodestone.operators import neighbours as nn


def table(spark, seed=0, n=400, width=8, copies=True):
    rng = np.random.default_rng(seed)
    vectors = rng.normal(size=(n, width)).astype(np.float32)
    if copies:
        vectors[100:230] = vectors[5]
    rows = [(i, vectors[i].tolist()) for i in range(n)]
    rows += [(n, None), (n + 1, [0.0] * width), (n + 2, [1.0]), (n + 3, [None] + [1.0] * (width - 1))]
    rows += [(n + 4, [float("nan")] * width)]
    return rows, spark.createDataFrame(rows, "row_key long, vector array<float>").repartition(7)


def questions(spark, seed=1, n=9, width=8):
    rng = np.random.default_rng(seed)
    rows = [(f"q{i}", rng.normal(size=width).tolist()) for i in range(n)]
    rows.append(("none", None))
    return rows, spark.createDataFrame(rows, "query_id string, vector array<double>")


def brute(rows, asked, k, metric, low=None, high=None):
    found = {}
    for query, q in asked:
        if q is None:
            continue
        q = np.array(q)
        near = []
        for key, v in rows:
            if v is None or len(v) != len(q) or any(x is None or np.isnan(x) for x in v):
                continue
            v = np.array(v, np.float64)
            if metric == "cosine":
                if not v.any():
                    continue
                d = 1 - v @ q / np.linalg.norm(v) / np.linalg.norm(q)
            else:
                d = ((v - q) ** 2).sum()
                d = np.sqrt(d) if metric == "l2" else d
            if (low is None or d >= low) and (high is None or d <= high):
                near.append((round(d, 9), key))
        found[query] = [(key, i + 1) for i, (_, key) in enumerate(sorted(near)[:k])]
    return found


def collected(found):
    result = {}
    for row in found.collect():
        result.setdefault(row.query_id, []).append((row["rank"], row.row_key))
    return {q: [(key, rank) for rank, key in sorted(v)] for q, v in result.items()}


@pytest.mark.parametrize("metric", nn.METRICS)
@pytest.mark.parametrize("k", [1, 30, 1000])
def test_exact(spark, metric, k):
    rows, df = table(spark)
    asked, queries = questions(spark)
    assert collected(nn.nearest(df, queries, k, metric=metric)) == brute(rows, asked, k, metric)


@pytest.mark.parametrize("metric,low,high", [("cosine", 0.7, 1.2), ("l2", 2.5, 4.0), ("l2_squared", None, 9.0)])
def test_range(spark, metric, low, high):
    rows, df = table(spark)
    asked, queries = questions(spark)
    found = nn.nearest(df, queries, 12, metric=metric, min_distance=low, max_distance=high)
    assert collected(found) == brute(rows, asked, 12, metric, low, high)


def test_queries_too_large_to_hold(spark):
    rows, df = table(spark)
    asked, queries = questions(spark, n=25)
    found = nn.nearest(df, queries, 10, max_query_bytes=2000, cell_bytes=100_000)
    assert collected(found) == brute(rows, asked, 10, "cosine")


def test_many_queries_in_one_batch(spark, monkeypatch):
    monkeypatch.setattr(nn, "FIRST_QUERIES", 4)
    rows, df = table(spark, n=60, copies=False)
    asked, queries = questions(spark, n=12)
    assert collected(nn.nearest(df, queries, 5)) == brute(rows, asked, 5, "cosine")


def test_no_queries(spark):
    _, df = table(spark)
    _, queries = questions(spark)
    assert nn.nearest(df, queries.where("query_id = 'nobody'"), 5).count() == 0


def test_text_and_compound_keys(spark):
    rows, df = table(spark, n=80)
    asked, queries = questions(spark, n=3)
    keyed = df.selectExpr("concat('f', row_key % 7) path", "row_key", "vector")
    found = nn.nearest(keyed, queries, 8, key=["path", "row_key"]).collect()
    named = [((f"f{key % 7}", key), v) for key, v in rows]
    got = {}
    for r in found:
        got.setdefault(r.query_id, []).append(((r.path, r.row_key), r["rank"]))
    assert {q: sorted(v, key=lambda x: x[1]) for q, v in got.items()} == brute(named, asked, 8, "cosine")


def test_large_distances_keep_precision(spark):
    rows = [(i, [1e4 + i * 1e-2, 1e4]) for i in range(50)]
    df = spark.createDataFrame(rows, "row_key long, vector array<float>")
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    asked = [("q", [1e4 + 0.2, 1e4])]
    queries = spark.createDataFrame(asked, "query_id string, vector array<double>")
    assert collected(nn.nearest(df, queries, 7, metric="l2")) == brute(rows, asked, 7, "l2")


def test_queries_of_several_widths(spark):
    rows, df = table(spark)
    asked, _ = questions(spark, n=3)
    for extra in ([("odd", [])], [("odd", [1.0])], [("odd", [1.0]), ("odder", [2.0])]):
        for order in (extra + asked, asked + extra):
            mixed = spark.createDataFrame(order, "query_id string, vector array<double>").coalesce(1)
            found = collected(nn.nearest(df, mixed, 5))
            wanted = {q: near for q, near in brute(rows, order, 5, "cosine").items() if near}
            assert found == wanted


def test_many_ties_in_small_slices(spark, monkeypatch):
    monkeypatch.setattr(nn, "PAIR_BYTES", 1 << 12)
    monkeypatch.setattr(nn, "PAIRS", 64)
    keys = np.random.default_rng(3).permutation(900)
    block = pa.table({"row_key": pa.array(keys)})
    queries = nn.QuerySet(pa.array(["a", "b"]), np.array([[1, 0], [0, 2]], np.float32))
    for metric in nn.METRICS:
        best = nn.Nearest(queries, nn.Search(7, metric), ["row_key"])
        vectors = np.tile(np.array([[1, 1]], np.float32), (900, 1))
        for start in range(0, 900, 300):
            best.add(block.slice(start, 300), vectors[start : start + 300])
        found = best.result("query_id").to_pylist()
        assert [(r["query_id"], r["row_key"]) for r in found] == [(q, i) for q in "ab" for i in range(7)]
