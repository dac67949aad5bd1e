"""Queries for merges, filters, embedding steps and the load job."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import embedding as E
from lodestone.operators import filters as K
from lodestone.operators import merge as M
from lodestone.operators import retrieve as R
from lodestone.operators.chunks import chunk_text, concat_chunks
from lodestone.operators.generation import stub_generator
from lodestone.operators.lines import explode_lines
from lodestone.plans import jobs
from lodestone.plans.registry import registered, table, wide_table
from lodestone.plans.text_queries import CAP, OVERLAP, TEXT_BLOCKS, chunks_sql, lines_sql
from lodestone.schema import ROW_CAP
from lodestone.session import scratch_path


@registered(
    """WITH s AS (
      SELECT d.doc_id, 'checked ' || d.text AS content FROM documents d
        WHERE d.doc_id IN (SELECT doc_id FROM labels)
      UNION ALL SELECT -1 - item_id, text FROM benchmark)
    SELECT doc_id, text AS content FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM s)
    UNION ALL SELECT doc_id, content FROM s"""
)
def upsert(spark, folder):
    """Labelled documents replaced and benchmark texts added."""
    documents = table(spark, folder, "documents").select("doc_id", F.col("text").alias("content"))
    checked = K.members(documents, "doc_id", table(spark, folder, "labels").select("doc_id"))
    changed = checked.withColumn("content", F.concat(F.lit("checked "), F.col("content")))
    added = table(spark, folder, "benchmark").select(
        (F.lit(-1) - F.col("item_id")).alias("doc_id"), F.col("text").alias("content")
    )
    return M.upsert(documents, changed.unionByName(added), ["doc_id"])


@registered(
    """WITH t AS (SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
    s AS (SELECT * FROM documents)
    SELECT doc_id, source, n_chars, 'held' AS origin FROM t
    UNION ALL
    SELECT doc_id, source, n_chars, 'new' FROM s WHERE NOT EXISTS (
      SELECT 1 FROM t WHERE t.text = s.text AND t.lang = s.lang AND t.source = s.source)"""
)
def insert_if_absent(spark, folder):
    """All documents put into the labelled ones, matched by content."""
    documents = table(spark, folder, "documents")
    held = K.members(documents, "doc_id", table(spark, folder, "labels").select("doc_id"))
    merged = M.insert_if_absent(
        held.withColumn("origin", F.lit("held")),
        documents.withColumn("origin", F.lit("new")),
        ["text", "lang", "source"],
    )
    return merged.select("doc_id", "source", "n_chars", "origin")


@registered(
    """SELECT e.vec_id, e.label FROM embeddings e WHERE NOT EXISTS (
      SELECT 1 FROM embeddings t JOIN labels l ON t.vec_id = l.doc_id
      WHERE t.embedding = e.embedding AND t.label = e.label)"""
)
def insert_vectors(spark, folder):
    """Vectors that a table of the labelled ones does not hold yet."""
    embeddings = table(spark, folder, "embeddings")
    held = K.members(embeddings, "vec_id", table(spark, folder, "labels").select("doc_id"))
    return M.new_rows(held, embeddings, ["embedding", "label"]).select("vec_id", "label")


@registered("SELECT doc_id, source AS metadata, text AS content FROM documents WHERE text IS NOT NULL")
def scan_all_content(spark, folder):
    documents = table(spark, folder, "documents").select(
        "doc_id", F.col("source").alias("metadata"), F.col("text").alias("content")
    )
    return R.all_content(documents, ["doc_id"], None)


@registered(
    """SELECT user_id, ts, event_id FROM events WHERE props IS NOT NULL
    ORDER BY user_id, ts LIMIT 1000"""
)
def row_cap(spark, folder):
    events = K.with_content(table(spark, folder, "events"), "props")
    return K.row_cap(events.select("user_id", "ts", "event_id"), ["user_id", "ts"], ROW_CAP)


@registered(
    """SELECT doc_id, source, text FROM documents WHERE source IN (
      SELECT d.source FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 1)"""
)
def in_metadata(spark, folder):
    """Documents of every source that has a toxic one."""
    documents = table(spark, folder, "documents")
    toxic = table(spark, folder, "labels").where("toxic = 1").select("doc_id")
    sources = K.members(documents, "doc_id", toxic).select("source")
    return K.members(documents, "source", sources).select("doc_id", "source", "text")


@registered(
    "SELECT doc_id, source, text FROM documents WHERE source IN ('src1', 'src7', 'it''s', 'src19')"
)
def in_metadata_list(spark, folder):
    documents = table(spark, folder, "documents")
    return K.members(documents, "source", ["src1", "src7", "it's", "src19"]).select(
        "doc_id", "source", "text"
    )


@registered(
    """WITH v AS (SELECT DISTINCT coalesce(try_cast(x AS INTEGER), 0) AS n FROM (
        SELECT json_extract_string(props, '$.k') AS x FROM events WHERE event_type = 'error'
        UNION ALL SELECT event_type FROM events))
    SELECT conv_id, turn, role FROM conversations WHERE turn IN (SELECT n FROM v)"""
)
def in_chunk_number(spark, folder):
    """Turns whose number is among texts, some of which are not numbers."""
    events = table(spark, folder, "events")
    texts = (
        events.where("event_type = 'error'")
        .select(F.get_json_object("props", "$.k").alias("x"))
        .unionByName(events.select(F.col("event_type").alias("x")))
    )
    turns = table(spark, folder, "conversations")
    return K.chunk_members(turns, "turn", texts).select("conv_id", "turn", "role")


@registered("SELECT DISTINCT source AS metadata FROM documents WHERE source IS NOT NULL")
def distinct_files(spark, folder):
    return K.file_names(table(spark, folder, "documents").select(F.col("source").alias("metadata")))


@registered(
    """SELECT coalesce(CAST(l.quality AS VARCHAR), 'NULL') AS quality
    FROM documents d LEFT JOIN labels l USING (doc_id)"""
)
def result_text(spark, folder):
    labels = table(spark, folder, "labels")
    joined = table(spark, folder, "documents").select("doc_id").join(labels, "doc_id", "left")
    return K.as_text(joined, "quality")


@registered(
    f"""WITH l AS ({lines_sql("text", "documents", "doc_id")})
    SELECT doc_id, line_no, line FROM l WHERE trim(line) <> ''"""
)
def query_check(spark, folder):
    """Every line as a query text; empty ones are dropped."""
    lines = explode_lines(wide_table(spark, folder, "documents"), "text", ["doc_id"])
    return K.checked_queries(lines, "line")


@registered(
    """SELECT 'doc' AS kind, doc_id AS id, text FROM documents
    UNION ALL SELECT 'turn', conv_id * 1000 + turn, text FROM conversations
    UNION ALL SELECT 'item', item_id, text FROM benchmark"""
)
def concat_texts(spark, folder):
    """Texts of several tables as one frame."""
    kind = lambda name: F.lit(name).alias("kind")
    turn = (F.col("conv_id") * 1000 + F.col("turn")).alias("id")
    return concat_chunks(
        [
            table(spark, folder, "documents").select(kind("doc"), F.col("doc_id").alias("id"), "text"),
            table(spark, folder, "conversations").select(kind("turn"), turn, "text"),
            table(spark, folder, "benchmark").select(kind("item"), F.col("item_id").alias("id"), "text"),
        ]
    )


@registered(
    chunks_sql(
        TEXT_BLOCKS,
        "doc_id",
        """SELECT doc_id, chunk_number, to_json(struct_pack(model := 'hashed',
             input := string_split_regex(chunk, '\\r?\\n'), metadata := source,
             chunk_number := chunk_number))::VARCHAR AS body
           FROM chunk JOIN documents USING (doc_id)""",
    )
)
def embed_requests(spark, folder):
    documents = wide_table(spark, folder, "documents")
    chunks = chunk_text(documents, "text", ["doc_id", "source"], CAP, OVERLAP)
    asked = E.embed_requests(chunks, "hashed", metadata="source")
    return asked.select("doc_id", "chunk_number", "body")


def _answered_requests(spark, folder):
    """Documents as requests, with responses that lack a vector for the last line; a text without lines has none."""
    documents = wide_table(spark, folder, "documents").select("doc_id", "source", "text")
    asked = E.embed_requests(
        documents.withColumn("number", F.lit(None).cast("int")), "hashed", "text", "source", "number"
    )
    lines = F.col("request.input")
    vectors = F.transform(
        F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))),
        lambda x, i: F.array(F.length(x).cast("float"), i.cast("float")),
    )
    response = F.to_json(
        F.struct(F.lit("hashed").alias("model"), vectors.alias("embeddings"))
    )
    return asked.withColumn("response", E.parse_response(response))


@registered(
    f"""WITH l AS ({lines_sql("text", "documents", "doc_id, source")}),
    n AS (SELECT doc_id, max(line_no) AS last FROM l GROUP BY doc_id)
    SELECT doc_id, source AS metadata, 0 AS chunk_number, 'hashed' AS model,
      CAST(line_no AS INTEGER) AS line_no, line AS content,
      CAST(length(line) AS DOUBLE) AS first, CAST(line_no AS DOUBLE) AS second
    FROM l JOIN n USING (doc_id) WHERE line_no < last"""
)
def embed_pairs(spark, folder):
    """Lines paired with the vectors of a response that is one vector short."""
    pairs = E.paired_lines(_answered_requests(spark, folder), ["doc_id"], strict=False)
    return pairs.select(
        "doc_id", "metadata", "chunk_number", "model", "line_no", "content",
        F.col("vector")[0].cast("double").alias("first"),
        F.col("vector")[1].cast("double").alias("second"),
    )


@registered(
    f"""WITH l AS ({lines_sql("text", "documents", "doc_id")})
    SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM l WHERE line_no = 1)"""
)
def embed_rejects(spark, folder):
    """Documents whose response holds no vector."""
    return E.empty_responses(_answered_requests(spark, folder)).select("doc_id")


@registered(
    f"""WITH l AS ({lines_sql("text", "documents", "doc_id")})
    SELECT doc_id, line_no, 768 AS width,
      CAST(CASE WHEN regexp_matches(line, '[\\p{{L}}\\p{{N}}]') THEN 1 ELSE 0 END AS DOUBLE) AS norm
    FROM l"""
)
def embed_hash(spark, folder):
    """Width and length of the vector of every line."""
    lines = explode_lines(wide_table(spark, folder, "documents"), "text", ["doc_id"])
    made = E.checked_width(E.embed_column(lines, "line", E.HashingEmbedder()), 768)
    square = F.aggregate(
        "vector", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")
    )
    return made.select(
        "doc_id", "line_no", F.size("vector").alias("width"), F.round(F.sqrt(square), 5).alias("norm")
    )


def _document_files(spark, folder):
    documents = wide_table(spark, folder, "documents")
    return documents.select(
        F.concat(F.lit("/data/"), "source", F.lit("/f"), "doc_id", F.lit(".txt")).alias("path"),
        F.concat(F.lit("f"), "doc_id", F.lit(".txt")).alias("metadata"),
        F.lit("text").alias("language"),
        "text",
    )


LOADED_LINES = lines_sql("chunk", "chunk", "doc_id, chunk_number")


@registered(
    chunks_sql(
        TEXT_BLOCKS,
        "doc_id",
        f"""SELECT 'f' || doc_id || '.txt' AS metadata, CAST(chunk_number AS INTEGER) AS chunk_number,
             CAST(line_no AS INTEGER) AS line_no, line AS content FROM ({LOADED_LINES})""",
    )
)
def load_table(spark, folder):
    """The whole load job over the documents; the lines of the stored table."""
    target = scratch_path(spark, "table")
    loaded = jobs.load(
        spark, _document_files(spark, folder), target, E.HashingEmbedder(64), partitions=16
    )
    return loaded.select("metadata", "chunk_number", "line_no", "content")


@registered()
def rag_batch(spark, folder):
    """Load, embed the benchmark texts, search the index, prompt and answer."""
    target = scratch_path(spark, "table")
    embedder = E.HashingEmbedder(64)
    loaded = jobs.load(spark, _document_files(spark, folder), target, embedder, partitions=16)
    queries = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    replies = jobs.rag_batch(
        loaded, queries, embedder, "You answer from the given content.", "small",
        lambda: stub_generator, search=jobs.search_index(spark, target, nprobes=8),
    )
    return replies.select(
        "query_id", F.length("context").alias("context_characters"), "status", "answer"
    )


@registered(
    chunks_sql(
        TEXT_BLOCKS,
        "doc_id",
        f""", l AS ({LOADED_LINES}),
        w AS (SELECT '/data/' || source || '/f' || doc_id || '.txt' AS path, chunk_number, line_no,
                regexp_extract_all(lower(line), '[\\p{{L}}\\p{{N}}]+') AS ws
              FROM l JOIN documents USING (doc_id)),
        t AS (SELECT path, chunk_number, line_no, len(ws) AS n, unnest(ws) AS term FROM w),
        p AS (SELECT path, chunk_number, line_no, n, term, count(*) AS tf FROM t GROUP BY ALL),
        c AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM w),
        f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
        q AS (SELECT DISTINCT item_id AS query_id,
                unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM benchmark),
        s AS (SELECT q.query_id, p.path, p.chunk_number, p.line_no, round(sum(
                ln(1 + (c.n - f.df + 0.5) / (f.df + 0.5)) * p.tf * 2.2
                / (p.tf + 1.2 * (1 - 0.75 + 0.75 * p.n / c.mean))), 9) AS score
              FROM q JOIN f USING (term) JOIN p USING (term) CROSS JOIN c GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (
                PARTITION BY query_id ORDER BY score DESC, path, chunk_number, line_no) AS rank
              FROM s)
        SELECT query_id, path, CAST(chunk_number AS INTEGER) AS chunk_number,
          CAST(line_no AS INTEGER) AS line_no, round(score, 6) AS score, rank
        FROM r WHERE rank <= 10""",
    )
)
def word_search(spark, folder):
    """Load, then keyword search over the stored postings for the benchmark texts."""
    target = scratch_path(spark, "table")
    jobs.load(
        spark, _document_files(spark, folder), target, E.HashingEmbedder(64), partitions=16
    )
    queries = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return jobs.search_words(spark, target, queries, 10).withColumn("score", F.round("score", 6))


def _letter_counts():
    """A model whose vectors SQL can make as well: 8, characters, letters e, blanks."""
    return lambda texts: [[8.0, len(x), x.count("e"), x.count(" ")] for x in texts]


COUNTS = E.FunctionEmbedder(_letter_counts, 4, "letter-counts")
VECTOR_SQL = (
    "[8.0, length(line), length(line) - length(replace(line, 'e', '')), "
    "length(line) - length(replace(line, ' ', ''))]::DOUBLE[]"
)
FILE_SQL = "'/data/' || source || '/f' || doc_id || '.txt'"
# Lines of the loaded documents with their chunk's place among all chunks of ``{where}``.
ALL_LINES = rf"""numbered AS (SELECT doc_id, chunk_number, chunk, {FILE_SQL} AS path,
      row_number() OVER (ORDER BY {FILE_SQL}, chunk_number) - 1 AS id
      FROM chunk JOIN documents USING (doc_id)),
    line AS (SELECT path, id, CAST(chunk_number AS INTEGER) AS chunk_number, CAST(line_no AS INTEGER) AS line_no, line
      FROM ({lines_sql("chunk", "numbered", "path, id, chunk_number")}))"""
SHOWN_VECTOR = "v[1] AS v1, v[2] AS v2, v[3] AS v3, v[4] AS v4"


def _shown_lines(loaded):
    vector = [F.col("vector")[k].cast("double").alias(f"v{k + 1}") for k in range(4)]
    whole = F.col("created_at") == F.date_trunc("second", "created_at")
    now = F.current_timestamp().cast("timestamp_ntz")
    recent = F.col("created_at").between(now - F.expr("INTERVAL 1 DAY"), now)
    return loaded.select(
        "path", "id", "chunk_number", "line_no", "content", "model", *vector, (whole & recent).alias("recent")
    )


@registered(
    chunks_sql(
        TEXT_BLOCKS,
        "doc_id",
        f""", {ALL_LINES}
        SELECT path, id, chunk_number, line_no, line AS content, 'letter-counts' AS model, {SHOWN_VECTOR},
          true AS recent FROM (SELECT *, {VECTOR_SQL} AS v FROM line)""",
    )
)
def load_vectors(spark, folder):
    """The load job with a called model: ids, vectors, model and time of every stored line."""
    target = scratch_path(spark, "table")
    return _shown_lines(jobs.load(spark, _document_files(spark, folder), target, COUNTS, partitions=4))


@registered(
    chunks_sql(
        TEXT_BLOCKS,
        "doc_id",
        f""", {ALL_LINES},
        held AS (SELECT DISTINCT path, id FROM line
                 WHERE path IN (SELECT {FILE_SQL} FROM documents JOIN labels USING (doc_id))),
        old AS (SELECT path, id, row_number() OVER (ORDER BY id) - 1 AS id_ FROM held)
        SELECT path, coalesce(old.id_, line.id + 1 + (SELECT max(id_) FROM old)) AS id, chunk_number, line_no,
          line AS content, 'letter-counts' AS model, {SHOWN_VECTOR}, true AS recent
        FROM (SELECT *, {VECTOR_SQL} AS v FROM line) line LEFT JOIN old USING (path, id)""",
    )
)
def load_then_insert(spark, folder):
    """The labelled documents loaded, then all added: held lines stay, new ones follow."""
    target = scratch_path(spark, "table")
    files = _document_files(spark, folder)
    marked = table(spark, folder, "labels").select(F.concat(F.lit("f"), "doc_id", F.lit(".txt")).alias("metadata"))
    jobs.load(spark, K.members(files, "metadata", marked), target, COUNTS, partitions=4)
    return _shown_lines(jobs.load_more(spark, files, target, COUNTS))


@registered(
    chunks_sql(
        TEXT_BLOCKS,
        "doc_id",
        f""", {ALL_LINES},
        marked AS (SELECT {FILE_SQL} AS path FROM documents JOIN labels USING (doc_id))
        SELECT path, id, chunk_number, line_no,
          CASE WHEN path IN (SELECT path FROM marked) THEN 'checked ' || line ELSE line END AS content,
          CASE WHEN path IN (SELECT path FROM marked) THEN 'checked' ELSE 'letter-counts' END AS model,
          {SHOWN_VECTOR}, true AS recent
        FROM (SELECT *, {VECTOR_SQL} AS v FROM line)""",
    )
)
def upsert_stored(spark, folder):
    """A stored table whose lines of labelled documents are put in place of the held ones."""
    target = scratch_path(spark, "table")
    loaded = jobs.load(spark, _document_files(spark, folder), target, COUNTS, partitions=4)
    marked = table(spark, folder, "labels").select(F.concat(F.lit("f"), "doc_id", F.lit(".txt")).alias("metadata"))
    changed = K.members(loaded, "metadata", marked).withColumn(
        "content", F.concat(F.lit("checked "), "content")
    ).withColumn("model", F.lit("checked"))
    return _shown_lines(jobs.upsert(spark, changed, target, jobs.KEY, partitions=4))


NEAREST_LINES = f"""{ALL_LINES},
    q AS (SELECT item_id AS query_id, {VECTOR_SQL} AS v FROM (SELECT item_id, text AS line FROM benchmark)),
    v AS (SELECT *, {VECTOR_SQL} AS v FROM line),
    d AS (SELECT q.query_id, v.*, list_cosine_distance(q.v, v.v) AS distance FROM q, v),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id
            ORDER BY distance, path, chunk_number, line_no) AS rank FROM d)"""


@registered(
    chunks_sql(
        TEXT_BLOCKS,
        "doc_id",
        f""", {NEAREST_LINES}
        SELECT query_id, rank, path, chunk_number, line_no, line AS content, round(distance, 6) AS distance
        FROM r WHERE rank <= 30""",
    )
)
def query_job(spark, folder):
    """Load the documents, then the 30 nearest lines for every benchmark text."""
    target = scratch_path(spark, "table")
    loaded = jobs.load(spark, _document_files(spark, folder), target, COUNTS, partitions=4)
    queries = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    found = jobs.query(loaded, queries, COUNTS)
    return found.select(
        "query_id", "rank", "path", "chunk_number", "line_no", "content", F.round("_distance", 6).alias("distance")
    )


@registered(
    chunks_sql(
        TEXT_BLOCKS,
        "doc_id",
        f""", {NEAREST_LINES}
        SELECT query_id, context, 'ok' AS status, length(context) AS characters FROM (
          SELECT query_id, string_agg(line, ' ' ORDER BY rank) AS context FROM r WHERE rank <= 30 GROUP BY query_id)""",
    )
)
def rag_job(spark, folder):
    """Load, search, prompt and answer as one job: the context of every benchmark text."""
    target = scratch_path(spark, "table")
    loaded = jobs.load(spark, _document_files(spark, folder), target, COUNTS, partitions=4)
    queries = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    replies = jobs.rag_batch(loaded, queries, COUNTS, "You answer from the given content.", "small", lambda: stub_generator)
    return replies.select("query_id", "context", "status", F.length("context").alias("characters"))
