"""Queries over the table of vectors.

The query vectors are the mean vectors of the labels, made from the whole
table, so the work grows with the table and not with its square.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import ivf
from lodestone.operators import neighbours as nn
from lodestone.operators import retrieve as R
from lodestone.operators.filters import members
from lodestone.plans.registry import registered, rounded, table
from lodestone.schema import ROW_CAP
from lodestone.session import checkpointed

PARTS = 16


def label_means(embeddings: DataFrame) -> DataFrame:
    """One query vector per label: the mean of its vectors."""
    points = embeddings.select(
        F.col("label").alias("query_id"),
        array_to_vector(F.col("embedding").cast("array<double>")).alias("_point"),
    )
    return points.groupBy("query_id").agg(
        vector_to_array(Summarizer.mean(F.col("_point"))).alias("vector")
    )


def mean_queries(embeddings: DataFrame) -> DataFrame:
    """The label means, computed once: searches read their queries several times."""
    return checkpointed(label_means(embeddings))


def overall_mean(embeddings: DataFrame) -> DataFrame:
    return mean_queries(embeddings.withColumn("label", F.lit(0)))


def _search(embeddings, queries, k, **options):
    return nn.nearest(embeddings, queries, k, key="vec_id", vector="embedding", **options)


def _shown(found: DataFrame) -> DataFrame:
    return found.select("query_id", "vec_id", rounded("_distance", "distance"), "rank")


# Shared SQL pieces: mean vector per label, distances, ranks.
MEANS = """
    q AS (
      SELECT query_id, list(m ORDER BY i) AS v FROM (
        SELECT label AS query_id, i, avg(x) AS m FROM (
          SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i
          FROM embeddings) GROUP BY label, i) GROUP BY query_id)"""
ALL_MEAN = MEANS.replace("label AS query_id", "0 AS query_id").replace("GROUP BY label, i", "GROUP BY i")


def _pairs(function: str, source: str = "embeddings e") -> str:
    return f"""
    d AS (
      SELECT q.query_id, e.vec_id, {function}(e.embedding::DOUBLE[], q.v) AS d
      FROM {source} CROSS JOIN q)"""


RANKED = """
    r AS (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM d)"""


def _top(function: str, k: int, means: str = MEANS, source: str = "embeddings e") -> str:
    return f"""WITH {means}, {_pairs(function, source)}, {RANKED}
    SELECT query_id, vec_id, round(d, 6) AS distance, rank FROM r WHERE rank <= {k}"""


@registered(_top("list_cosine_distance", 30))
def knn_cosine_batch(spark: SparkSession, folder: str) -> DataFrame:
    embeddings = table(spark, folder, "embeddings")
    return _shown(_search(embeddings, mean_queries(embeddings), 30))


@registered(_top("list_cosine_distance", 30, ALL_MEAN))
def knn_cosine_single(spark, folder):
    embeddings = table(spark, folder, "embeddings")
    return _shown(_search(embeddings, overall_mean(embeddings), 30))


@registered(_top("list_distance", 30))
def knn_l2_batch(spark, folder):
    embeddings = table(spark, folder, "embeddings")
    return _shown(_search(embeddings, mean_queries(embeddings), 30, metric="l2"))


@registered(_top("list_cosine_distance", 30))
def knn_cosine_grid(spark, folder):
    """The way taken by query sets too large to hold in memory."""
    embeddings = table(spark, folder, "embeddings")
    queries = mean_queries(embeddings)
    return _shown(
        _search(embeddings, queries, 30, max_query_bytes=16 << 10, cell_bytes=1 << 20)
    )


GOOD = "embeddings e JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) g ON e.vec_id = g.doc_id"


@registered(
    f"""WITH {MEANS}, {_pairs("list_cosine_distance")}, {RANKED}
    SELECT query_id, vec_id, label, round(d, 6) AS distance, rank
    FROM r JOIN embeddings USING (vec_id)
    WHERE rank <= 30 AND vec_id IN (SELECT doc_id FROM labels WHERE quality = 1)"""
)
def knn_postfilter(spark, folder):
    embeddings = table(spark, folder, "embeddings")
    good = table(spark, folder, "labels").where("quality = 1").select("doc_id")
    marked = embeddings.join(
        good.distinct().withColumn("good", F.lit(True)),
        F.col("vec_id") == F.col("doc_id"),
        "left",
    )
    found = R.nearest_lines(
        marked, mean_queries(embeddings), 30, key=["vec_id"], columns=["label"],
        vector="embedding", postfilter=F.col("good").isNotNull(),
    )
    return found.select("query_id", "vec_id", "label", rounded("_distance", "distance"), "rank")


@registered(_top("list_cosine_distance", 30, source=GOOD))
def knn_prefilter(spark, folder):
    embeddings = table(spark, folder, "embeddings")
    good = table(spark, folder, "labels").where("quality = 1").select("doc_id")
    kept = members(embeddings, "vec_id", good)
    return _shown(_search(kept, mean_queries(embeddings), 30))


@registered(
    f"""WITH {MEANS}, {_pairs("list_distance")},
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank
          FROM d WHERE d BETWEEN 0.95 AND 1.0)
    SELECT query_id, vec_id, round(d, 6) AS distance, rank FROM r WHERE rank <= 20"""
)
def knn_distance_range(spark, folder):
    embeddings = table(spark, folder, "embeddings")
    return _shown(
        _search(
            embeddings, mean_queries(embeddings), 20, metric="l2",
            min_distance=0.95, max_distance=1.0,
        )
    )


def _label_centroids(means: DataFrame) -> ivf.Centroids:
    means = means.select(
        F.col("query_id").alias("part"), F.col("vector").alias("centroid")
    )
    return ivf.Centroids.from_frame(means)


PLACED = """
    a AS (
      SELECT e.vec_id, e.embedding, q.query_id AS part, row_number() OVER (
        PARTITION BY e.vec_id ORDER BY list_distance(e.embedding::DOUBLE[], q.v), q.query_id) AS n
      FROM embeddings e CROSS JOIN q),
    placed AS (SELECT vec_id, embedding, part FROM a WHERE n = 1)"""


@registered(f"WITH {MEANS}, {PLACED} SELECT vec_id, part FROM placed")
def ivf_assign(spark, folder):
    embeddings = table(spark, folder, "embeddings")
    placed = ivf.assign_partitions(embeddings, _label_centroids(label_means(embeddings)), "embedding")
    return placed.select("vec_id", "part")


@registered(
    f"""WITH {MEANS}, {PLACED},
    near AS (
      SELECT x.query_id, y.query_id AS part, row_number() OVER (
        PARTITION BY x.query_id ORDER BY list_distance(x.v, y.v), y.query_id) AS n
      FROM q x CROSS JOIN q y),
    d AS (
      SELECT q.query_id, p.vec_id, list_distance(p.embedding::DOUBLE[], q.v) AS d
      FROM q JOIN near n ON n.query_id = q.query_id AND n.n <= 4 JOIN placed p ON p.part = n.part),
    {RANKED}
    SELECT query_id, vec_id, round(d, 6) AS distance, rank FROM r WHERE rank <= 10"""
)
def ivf_probe_search(spark, folder):
    embeddings = table(spark, folder, "embeddings")
    queries = mean_queries(embeddings)
    centroids = _label_centroids(queries)
    placed = ivf.assign_partitions(embeddings, centroids, "embedding")
    return _shown(
        ivf.probed_nearest(
            placed, centroids, queries, 10, 4,
            key="vec_id", vector="embedding", metric="l2",
        )
    )


@registered()
def ivf_train(spark, folder):
    """Trained partitions with their sizes."""
    embeddings = table(spark, folder, "embeddings")
    centroids = ivf.train_centroids(embeddings, "embedding", PARTS)
    placed = ivf.assign_partitions(embeddings, centroids, "embedding")
    return placed.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))


@registered(_top("list_cosine_distance", 30))
def ivf_probe_all(spark, folder):
    """Probing every trained partition gives the exact answer."""
    embeddings = table(spark, folder, "embeddings")
    centroids = ivf.train_centroids(embeddings, "embedding", PARTS)
    placed = ivf.assign_partitions(embeddings, centroids, "embedding")
    return _shown(
        ivf.probed_nearest(
            placed, centroids, mean_queries(embeddings), 30, PARTS,
            key="vec_id", vector="embedding",
        )
    )


RANGES = """
    x AS (
      SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i
      FROM embeddings),
    m AS (SELECT i, min(x) AS lo, max(x) AS hi FROM x GROUP BY i)"""


@registered(
    f"""WITH {RANGES}
    SELECT vec_id, i - 1 AS dim,
      CAST(CASE WHEN hi > lo THEN floor((x - lo) / (hi - lo) * 255) ELSE 0 END AS INTEGER) AS code
    FROM x JOIN m USING (i)"""
)
def sq_encode(spark, folder):
    embeddings = table(spark, folder, "embeddings")
    quantizer = ivf.Quantizer.fit(embeddings, "embedding")
    coded = ivf.encode_vectors(embeddings, quantizer, "embedding")
    return coded.select("vec_id", F.posexplode("codes").alias("dim", "code")).withColumn(
        "code", F.col("code").cast("int")
    )


@registered(
    f"""WITH {MEANS}, {RANGES},
    c AS (
      SELECT vec_id, list(lo + CASE WHEN hi > lo THEN floor((x - lo) / (hi - lo) * 255) ELSE 0 END
                          * ((hi - lo) / 255) ORDER BY i) AS v
      FROM x JOIN m USING (i) GROUP BY vec_id),
    s AS (
      SELECT q.query_id, c.vec_id, q.v AS asked, row_number() OVER (
        PARTITION BY q.query_id ORDER BY list_cosine_distance(c.v, q.v), c.vec_id) AS n
      FROM c CROSS JOIN q),
    d AS (
      SELECT s.query_id, s.vec_id, list_cosine_distance(e.embedding::DOUBLE[], s.asked) AS d
      FROM s JOIN embeddings e USING (vec_id) WHERE s.n <= 20),
    {RANKED}
    SELECT query_id, vec_id, round(d, 6) AS distance, rank FROM r WHERE rank <= 10"""
)
def knn_refine(spark, folder):
    embeddings = table(spark, folder, "embeddings")
    quantizer = ivf.Quantizer.fit(embeddings, "embedding")
    coded = ivf.encode_vectors(embeddings, quantizer, "embedding")
    return _shown(
        ivf.refined_nearest(
            coded, quantizer, mean_queries(embeddings), 10, 2, key="vec_id", vector="embedding"
        )
    )


@registered()
def index_search(spark, folder):
    """Trained partitions, probes, byte codes and re-ranking together."""
    embeddings = table(spark, folder, "embeddings")
    centroids = ivf.train_centroids(embeddings, "embedding", PARTS)
    quantizer = ivf.Quantizer.fit(embeddings, "embedding")
    placed = ivf.assign_partitions(embeddings, centroids, "embedding")
    placed = ivf.encode_vectors(placed, quantizer, "embedding")
    return _shown(
        ivf.refined_nearest(
            placed, quantizer, mean_queries(embeddings), 30, centroids=centroids, nprobes=6,
            key="vec_id", vector="embedding",
        )
    )


@registered(_top("list_cosine_distance", 30))
def index_search_all(spark, folder):
    """Codes of all partitions, re-ranked with full vectors: the exact answer."""
    embeddings = table(spark, folder, "embeddings")
    centroids = ivf.train_centroids(embeddings, "embedding", PARTS)
    quantizer = ivf.Quantizer.fit(embeddings, "embedding")
    placed = ivf.assign_partitions(embeddings, centroids, "embedding")
    placed = ivf.encode_vectors(placed, quantizer, "embedding")
    return _shown(
        ivf.refined_nearest(
            placed, quantizer, mean_queries(embeddings), 30, centroids=centroids, nprobes=PARTS,
            key="vec_id", vector="embedding",
        )
    )


def lines_with_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors with the text and file name of the document of the same number."""
    documents = table(spark, folder, "documents").select(
        "doc_id", F.col("source").alias("metadata"), F.col("text").alias("content")
    )
    embeddings = table(spark, folder, "embeddings")
    return embeddings.join(documents, F.col("vec_id") == F.col("doc_id")).drop("doc_id")


JOINED = f"""WITH {MEANS}, t AS (
      SELECT e.vec_id, e.embedding, e.label, d.source AS metadata, d.text AS content
      FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id),
    {_pairs("list_cosine_distance", "t e")}, {RANKED}"""


@registered(
    f"""{JOINED}
    SELECT r.query_id, r.rank, t.metadata, t.content FROM r JOIN t USING (vec_id) WHERE rank <= 30"""
)
def nearest_content(spark, folder):
    lines = lines_with_vectors(spark, folder)
    queries = mean_queries(table(spark, folder, "embeddings"))
    found = R.retrieve(lines, queries, "nearest", 30, key=["vec_id"], vector="embedding")
    return found.select("query_id", "rank", "metadata", "content")


@registered(
    f"""{JOINED},
    f AS (SELECT DISTINCT r.query_id, t.metadata FROM r JOIN t USING (vec_id) WHERE r.rank <= 4)
    SELECT f.query_id, t.metadata, t.vec_id, t.content FROM f JOIN t USING (metadata)"""
)
def file_context(spark, folder):
    lines = lines_with_vectors(spark, folder)
    queries = mean_queries(table(spark, folder, "embeddings"))
    found = R.retrieve(
        lines, queries, "file", 4, cap=None, key=["vec_id"], vector="embedding", file="metadata"
    )
    return found.select("query_id", "metadata", "vec_id", "content")


@registered(
    f"""{JOINED},
    f AS (SELECT DISTINCT r.query_id, t.metadata FROM r JOIN t USING (vec_id) WHERE r.rank <= 4),
    w AS (SELECT f.query_id, t.metadata, t.vec_id, row_number() OVER (
            PARTITION BY f.query_id ORDER BY t.metadata, t.vec_id) AS rank
          FROM f JOIN t USING (metadata))
    SELECT query_id, metadata, vec_id, rank FROM w WHERE rank <= 1000"""
)
def file_context_capped(spark, folder):
    lines = lines_with_vectors(spark, folder)
    queries = mean_queries(table(spark, folder, "embeddings"))
    found = R.retrieve(
        lines, queries, "file", 4, cap=ROW_CAP, key=["vec_id"], vector="embedding", file="metadata"
    )
    return found.select("query_id", "metadata", "vec_id", "rank")


@registered(
    f"""{JOINED},
    f AS (SELECT DISTINCT r.query_id, t.metadata, t.label
          FROM r JOIN t USING (vec_id) WHERE r.rank <= 10)
    SELECT f.query_id, t.metadata, t.label, t.vec_id, t.content
    FROM f JOIN t USING (metadata, label)"""
)
def chunk_context(spark, folder):
    lines = lines_with_vectors(spark, folder)
    queries = mean_queries(table(spark, folder, "embeddings"))
    found = R.retrieve(
        lines, queries, "chunk", 10, cap=None, key=["vec_id"], vector="embedding",
        chunk=["metadata", "label"],
    )
    return found.select("query_id", "metadata", "label", "vec_id", "content")


@registered(
    f"""{JOINED}
    SELECT r.query_id, string_agg(t.content, ' ' ORDER BY r.rank) AS context
    FROM r JOIN t USING (vec_id) WHERE rank <= 30 GROUP BY r.query_id"""
)
def context_string(spark, folder):
    lines = lines_with_vectors(spark, folder)
    queries = mean_queries(table(spark, folder, "embeddings"))
    found = R.retrieve(lines, queries, "nearest", 30, key=["vec_id"], vector="embedding")
    return R.context_string(found)
