import pytest
from pyspark.errors import PySparkException

from lodestone.operators import filters as K
from lodestone.operators import merge as M


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_upsert(spark):
    target = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (None, "c", 3)], "id int, content string, v int")
    source = spark.createDataFrame([(2, "b", 20), (3, "d", 30), (None, "c", 40)], "id int, content string, v int")
    assert rows(M.upsert(target, source), "id", "content", "v") == sorted(
        [(1, "a", 1), (2, "b", 20), (3, "d", 30), (None, "c", 40)], key=str
    )
    doubled = source.unionByName(source)
    with pytest.raises(PySparkException, match="twice"):
        M.upsert(target, doubled).collect()


def vectors(spark, rows):
    schema = "content string, metadata string, vector array<float>, model string, chunk_number int, tag string"
    return spark.createDataFrame(rows, schema)


def test_insert_if_absent(spark):
    target = vectors(spark, [("a", "f", [1.0, None], "m", None, "old"), ("b", "f", None, "m", 1, "old")])
    source = vectors(
        spark,
        [
            ("a", "f", [1.0, None], "m", None, "new"),
            ("b", "f", None, "m", 1, "new"),
            ("b", "f", None, "m", 2, "new"),
            ("c", "f", [1.0], "m", 1, "new"),
            ("c", "f", [1.0], "m", 1, "new"),
        ],
    )
    merged = M.insert_if_absent(target, source, M.CONTENT_KEYS)
    assert rows(merged, "content", "chunk_number", "tag") == sorted(
        [("a", None, "old"), ("b", 1, "old"), ("b", 2, "new"), ("c", 1, "new"), ("c", 1, "new")], key=str
    )
    assert M.new_rows(merged, source, M.CONTENT_KEYS).count() == 0


def test_insert_with_a_hot_key(spark):
    many = spark.range(3000).selectExpr("if(id < 1000, '', concat('x', id)) content", "id % 2 = 0 even")
    found = M.new_rows(many.where("even"), many, ["content"])
    assert found.count() == 1000 and found.where("content = ''").count() == 0


def test_members(spark):
    df = spark.createDataFrame([("a",), ("it's",), ("b",), (None,)], "metadata string")
    assert set(rows(K.members(df, "metadata", ["a", "it's"]), "metadata")) == {("a",), ("it's",)}
    assert K.members(df, "metadata", []).count() == 0
    files = spark.createDataFrame([("b",), ("b",), ("zz",)], "name string")
    assert rows(K.members(df, "metadata", files), "metadata") == [("b",)]


def test_chunk_members(spark):
    df = spark.range(8).selectExpr("cast(id as int) chunk_number")
    texts = spark.createDataFrame([("5",), ("x",), ("3",)], "t string")
    assert rows(K.chunk_members(df, "chunk_number", texts), "chunk_number") == [(0,), (3,), (5,)]


def test_filters(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id int, content string")
    assert rows(K.with_content(df), "id") == [(1,), (3,)]
    assert [r.id for r in K.row_cap(df, ["id"], 2).collect()] == [1, 2]
    assert K.row_cap(df, ["id"], None).count() == 3
    assert rows(K.as_text(df, "content"), "content") == [("NULL",), ("a",), ("c",)]
    assert rows(K.as_text(df, "id"), "id") == [("1",), ("2",), ("3",)]
    assert K.as_text(df, "missing").count() == 0
    with pytest.raises(TypeError):
        K.as_text(df.selectExpr("double(id) x"), "x")


def test_empty_queries(spark):
    df = spark.createDataFrame([(1, "a"), (2, "  "), (3, None)], "query_id int, text string")
    assert rows(K.checked_queries(df), "query_id") == [(1,)]
    with pytest.raises(PySparkException, match="empty"):
        K.checked_queries(df, strict=True).collect()
