import math

import pytest
from pyspark.errors import PySparkException
from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F
from test_postings import terms

from lodestone.operators import embedding as E
from lodestone.plans import table_queries as Q

TEXTS = ["The end of the road", "", None, "42 Über über", " -- "]


def frame(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")


def test_hashed_terms(spark):
    place = HashingTF(inputCol="a", outputCol="b", numFeatures=32).indexOf
    for row in E.embed_column(frame(spark), "text", E.HashingEmbedder(32)).collect():
        counts = [0.0] * 32
        for term in terms(row.text or ""):
            counts[place(term)] += 1
        norm = math.sqrt(sum(c * c for c in counts)) or 1.0
        assert row.vector == pytest.approx([c / norm for c in counts], abs=1e-6)
        assert set(row.asDict()) == {"i", "text", "vector"}


def test_any_function(spark):
    embedder = E.FunctionEmbedder(lambda: lambda texts: [[len(t), 1.0] for t in texts], 2, "size", 2)
    found = E.embed_column(frame(spark), "text", embedder, tasks=2).collect()
    assert {r.i: r.vector for r in found} == {i: [len(t or ""), 1.0] for i, t in enumerate(TEXTS)}
    short = E.FunctionEmbedder(lambda: lambda texts: [], 2, "none")
    with pytest.raises(PySparkException, match="another number"):
        E.embed_column(frame(spark), "text", short).collect()


def answered(spark, vectors):
    chunks = spark.createDataFrame([("a\nb\nc", "f", 2), ("x", None, None)], "chunk string, metadata string, chunk_number int")
    asked = E.embed_requests(chunks, "m")
    body = F.to_json(F.struct(F.lit("m").alias("model"), F.lit(vectors).alias("embeddings"))) if vectors else F.lit('{"model":"m"}')
    return asked.withColumn("response", E.parse_response(body))


def test_requests_and_responses(spark):
    df = answered(spark, [[1.0, 2.0], [3.0, 4.0]])
    assert df.first().body == '{"model":"m","input":["a","b","c"],"metadata":"f","chunk_number":2}'
    found = E.paired_lines(df).collect()
    assert [(r.metadata, r.chunk_number, r.line_no, r.content, r.vector) for r in found[:2]] == [
        ("f", 2, 0, "a", [1.0, 2.0]), ("f", 2, 1, "b", [3.0, 4.0]),
    ]
    assert found[2].metadata == "Empty" and found[2].chunk_number == 0


def test_empty_responses(spark):
    df = answered(spark, None)
    assert E.empty_responses(df).count() == 2
    assert E.paired_lines(df, strict=False).count() == 0
    with pytest.raises(PySparkException, match="no vectors"):
        E.paired_lines(df).collect()


def test_width_and_time(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None)], "i int, vector array<float>")
    assert [r.i for r in E.wrong_width(df, 2).collect()] == [2]
    assert E.checked_width(df.where("i <> 2"), 2).count() == 2
    with pytest.raises(PySparkException, match="width"):
        E.checked_width(df, 2).collect()
    times = spark.range(3).select(E.load_time().alias("t")).distinct()
    assert times.schema["t"].dataType.typeName() == "timestamp_ntz"
    assert times.count() == 1 and times.first().t.microsecond == 0


def test_equal_lines_are_counted_without_sorting_them(spark, monkeypatch):
    """Lines are grouped by hash, and no digest is stored beside each."""
    seen, real = [], E.stored
    monkeypatch.setattr(E, "stored", lambda df, name: seen.append((name, df.columns, df._jdf.queryExecution().executedPlan().toString())) or real(df, name))
    df = spark.createDataFrame([(k, f"line {k % 7}" if k % 5 else None) for k in range(300)], "i int, text string")
    embedder = E.FunctionEmbedder(lambda: lambda texts: [[len(t), 1.0] for t in texts], 2, "size")
    rows, vectors = E.embed_distinct(df, "text", embedder)
    assert sorted((r.i, r.text, r.vector) for r in rows.where("text IS NOT NULL").collect()) == sorted(
        (r.i, r.text, [6.0, 1.0]) for r in df.where("text IS NOT NULL").collect()
    )
    assert rows.count() == 300 and vectors.count() == 8
    assert not any("SortAggregate" in plan or "ObjectHashAggregate" in plan for _, _, plan in seen)
    assert not any("_digest" in columns for name, columns, _ in seen if name == "texts")


def test_hashed_terms_are_those_of_the_ml_library(spark):
    from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    texts = ["", None, " -- ", "a", "Ab abc ABCD abcde abcdef abcdefg abcdefgh a a", "İIΣ Σx été \U0001f600\U00010400b x2²", "w" * 999]
    texts += [f"a{chr(c)}B {chr(c)}" for c in [*range(1, 0xD800, 7), *range(0xE000, 0x1F000, 11)]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(3)
    plain = df.withColumn("text", F.coalesce("t", F.lit("")))
    plain = RegexTokenizer(inputCol="text", outputCol="w", pattern=r"[^\p{L}\p{N}]+").transform(plain)
    plain = HashingTF(inputCol="w", outputCol="c", numFeatures=50).transform(plain)
    plain = Normalizer(inputCol="c", outputCol="u").transform(plain)
    wanted = plain.select("i", vector_to_array("u", "float32").alias("v"))
    made = E.HashingEmbedder(50).embed(df, "t", "v").select("i", "v")
    assert made.exceptAll(wanted).count() == 0 and made.count() == len(texts)
    # no function of its own takes texts apart row by row: one hashes, one scales, one gives the array
    assert made._jdf.queryExecution().executedPlan().toString().count("regexp_extract_all") >= 1


def documents(spark, folder, texts):
    rows = [(i, text, "s") for i, text in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


ODD_TEXTS = ["", "a\nbc\nd", None, "one", "\n", "x\r\n\ny\n"]


def test_pairs_of_documents_without_lines(spark, tmp_path):
    found = Q.embed_pairs(spark, documents(spark, tmp_path, ODD_TEXTS)).collect()
    assert sorted((r.doc_id, r.line_no, r.content, r.first, r.second) for r in found) == [
        (1, 0, "a", 1.0, 0.0), (1, 1, "bc", 2.0, 1.0), (5, 0, "x", 1.0, 0.0), (5, 1, "", 0.0, 1.0),
    ]


def test_rejects_of_documents_without_lines(spark, tmp_path):
    found = Q.embed_rejects(spark, documents(spark, tmp_path, ODD_TEXTS)).collect()
    assert sorted(r.doc_id for r in found) == [0, 2, 3, 4]
