"""Whole jobs: load, query, retrieve and prompt, prompt only."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import ivf
from lodestone.operators import prompts as P
from lodestone.operators import retrieve as R
from lodestone.operators.blocks import BLOCKS, blocks_of, placed_rows, search_blocks, text_totals
from lodestone.operators.chunks import chunk_files, chunk_log, chunk_rows, declaration_start, number_chunks
from lodestone.operators.embedding import Embedder, checked_width, embed_column, embed_distinct, load_time
from lodestone.operators.generation import Generator, checked_json, generate, parse_reply, reply_text
from lodestone.operators.lines import drop_noise, error_context, explode_lines
from lodestone.operators.merge import INSERT_KEYS, UPSERT_KEYS, new_rows
from lodestone.operators.merge import upsert as merged
from lodestone.schema import (
    CHUNK_OVERLAP,
    CHUNK_SIZE,
    LANGUAGES,
    MAX_ITERATIONS,
    NEIGHBOURS,
    PARTITIONS,
    PROBES,
    REFINE_FACTOR,
    SAMPLE_RATE,
    vector_table,
)
from lodestone.session import checkpointed, stored
from lodestone.sources.files import name_pattern, read_ended_lines, read_files, read_lines, spread
from lodestone.sources.tables import create_table, fitted, load_folder, open_loads, open_table, publish, published

KEY = list(R.LINE_KEY)


#: Bytes up to which a text or code file is split as one value; a larger one is split by rows, into the same chunks.
WHOLE_BYTES = 4 << 20


def chunk_folder(
    spark: SparkSession,
    path: str,
    cap: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    strict: bool = True,
    whole_bytes: int = WHOLE_BYTES,
) -> DataFrame:
    """Chunks of all files below a path: ``path, metadata, chunk_number, chunk``.

    No file needs to fit in a task: logs and large files are read by lines.
    """
    others = sorted(set(LANGUAGES.values()) - {"log"})
    files = spread(read_files(spark, path, strict, others, whole_bytes))
    chunks = chunk_files(files, ["path", "metadata"], cap, overlap)
    large = read_ended_lines(spark, path, others, whole_bytes, strict)
    order, boundary = ["block", "row"], declaration_start(F.col("language"))
    chunks = chunks.unionByName(
        chunk_rows(large, "path", order, F.col("block"), ["metadata"], cap, overlap, boundary)
    )
    lines = read_lines(spark, path, name_pattern(["log"]), strict)
    numbered = drop_noise(lines, "path", order, F.col("block"))
    return chunks.unionByName(chunk_log(error_context(numbered, "path"), "path", ["metadata"], cap, overlap))


def embedded_rows(
    chunks: DataFrame,
    embedder: Embedder,
    slice_by: Column | None = None,
    tasks: int | None = None,
    known: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """One row of the vector table per line of each chunk, and the vectors by line for later loads.

    Where a text costs a call of a model, each distinct line is embedded once,
    and not at all if ``known`` has its vector.
    """
    lines = explode_lines(
        number_chunks(chunks, "path", slice_by), "chunk", ["id", "path", "metadata", "chunk_number"]
    ).withColumnRenamed("line", "content")
    if embedder.calls_model:
        made, vectors = embed_distinct(lines, "content", embedder, "vector", tasks, known)
    else:
        made, vectors = embed_column(lines, "content", embedder, "vector", tasks), None
    made = made.withColumn("model", F.lit(embedder.model)).withColumn("created_at", load_time())
    return fitted(checked_width(made, embedder.dimension), vector_table()), vectors


def vector_rows(
    chunks: DataFrame, embedder: Embedder, slice_by: Column | None = None, tasks: int | None = None
) -> DataFrame:
    """One row of the vector table per line of each chunk."""
    return embedded_rows(chunks, embedder, slice_by, tasks)[0]


#: Files that a load may make of its lines, so that they need not be brought together by partition.
LINE_FILES = 4096

LINES, CENTROIDS, RANGES, NUMBERS, VECTORS = "lines", "centroids", "ranges", "numbers", "vectors"
INDEXED = ("metadata", "content")
VECTOR_ROWS = "digest binary, vector array<float>, model string"


def blocks_name(column: str) -> str:
    return f"words_{column}/blocks"


def totals_name(column: str) -> str:
    return f"words_{column}/totals"


def load(
    spark: SparkSession,
    source: str | DataFrame,
    target: str,
    embedder: Embedder,
    chunk_size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    partitions: int = PARTITIONS,
    tasks: int | None = None,
    strict: bool = True,
) -> DataFrame:
    """Load files (a path, or a frame ``path, metadata, language, text``) into a
    searchable table that replaces what the target held; returns the table.

    Chunks are stored before they are numbered and embedded: both steps read
    them, and a lost executor must not repeat the splitting. The new table with
    all its indexes takes the place of the old one in one step at the end; a load
    that fails leaves the old one as it was.
    """
    if isinstance(source, str):
        chunks = chunk_folder(spark, source, chunk_size, overlap, strict)
    else:
        chunks = chunk_files(source, ["path", "metadata"], chunk_size, overlap)
    rows, vectors = embedded_rows(stored(chunks, "chunks"), embedder, None, tasks, _known(spark, target, embedder))
    return replace(spark, rows, target, partitions, _named(vectors, embedder))


def load_more(
    spark: SparkSession,
    source: DataFrame,
    target: str,
    embedder: Embedder,
    chunk_size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    partitions: int = PARTITIONS,
    tasks: int | None = None,
) -> DataFrame:
    """Add files ``path, metadata, language, text`` to a table, see ``insert``; returns the table."""
    chunks = stored(chunk_files(source, ["path", "metadata"], chunk_size, overlap), "chunks")
    rows, vectors = embedded_rows(chunks, embedder, None, tasks, _known(spark, target, embedder))
    return insert(spark, rows, target, partitions=partitions, vectors=_named(vectors, embedder))


def _known(spark: SparkSession, target: str, embedder: Embedder) -> DataFrame | None:
    """Vectors by line that a table holds from the same model."""
    _, loads = published(spark, target)
    if not loads or not embedder.calls_model:
        return None
    held = open_loads(spark, target, VECTORS, loads, VECTOR_ROWS)
    same = (F.col("model") == embedder.model) & (F.size("vector") == embedder.dimension)
    return held.where(same).dropDuplicates(["digest"])


def _named(vectors: DataFrame | None, embedder: Embedder) -> DataFrame | None:
    return None if vectors is None else vectors.withColumn("model", F.lit(embedder.model))


def _write_vectors(spark: SparkSession, target: str, load: str, vectors: DataFrame | None) -> None:
    """Write the vectors by line of a load; an empty table where no model was called."""
    if vectors is None:
        vectors = spark.createDataFrame([], VECTOR_ROWS)
    create_table(spark, load_folder(target, VECTORS, load), vectors)


def replace(
    spark: SparkSession,
    rows: DataFrame,
    target: str,
    partitions: int = PARTITIONS,
    vectors: DataFrame | None = None,
) -> DataFrame:
    """Make the rows of ``vector_rows`` the whole of a searchable table."""
    rows = rows if "row_no" in rows.columns else placed_rows(rows)
    number, _ = published(spark, target)
    load = uuid.uuid4().hex
    quantizer = ivf.Quantizer.fit(rows, "vector", unit=True)
    centroids = ivf.train_centroids(
        rows, "vector", partitions, SAMPLE_RATE, MAX_ITERATIONS, rows=quantizer.rows
    )
    create_table(spark, load_folder(target, CENTROIDS, load), centroids.frame(spark))
    create_table(spark, load_folder(target, RANGES, load), quantizer.frame(spark))
    _write_load(spark, rows, target, load, centroids, quantizer)
    _write_vectors(spark, target, load, vectors)
    publish(spark, target, [load], number)
    return open_lines(spark, target)


def _write_load(
    spark: SparkSession,
    rows: DataFrame,
    target: str,
    load: str,
    centroids: ivf.Centroids,
    quantizer: ivf.Quantizer,
) -> None:
    """Write numbered rows by coarse partition with their codes, their numbers, and their words.

    A task writes its rows to the folders of their partitions, without a shuffle.
    Where that would make very many files, rows are brought together by partition
    first; a partition that holds far more than the others is then split over
    several tasks.
    """
    placed = ivf.place_and_encode(rows.drop("row_no"), centroids, quantizer)
    if rows.rdd.getNumPartitions() * len(centroids.numbers) > LINE_FILES:
        placed = placed.hint("rebalance", "part")
    create_table(spark, load_folder(target, LINES, load), placed, ["part"])
    create_table(spark, load_folder(target, NUMBERS, load), rows.select(*KEY, "row_no"))
    for column in INDEXED:
        index_words(spark, rows.drop("row_no"), rows, target, load, column)


def index_words(
    spark: SparkSession, rows: DataFrame, numbers: DataFrame, target: str, load: str, column: str
) -> None:
    """Write the words of one text column: blocks of postings by bucket of terms, and the totals of the texts.

    ``numbers`` are the rows with their ``row_no``, so that no text has to look for its number.
    """
    texts = numbers.select("row_no", F.col(column).alias("text"))
    create_table(spark, load_folder(target, blocks_name(column), load), blocks_of(texts), ["bucket"])
    blocks = open_loads(spark, target, blocks_name(column), [load], BLOCKS)
    shown = rows.where(F.col(column).isNotNull())
    create_table(spark, load_folder(target, totals_name(column), load), text_totals(shown, blocks))


def insert(
    spark: SparkSession,
    rows: DataFrame,
    target: str,
    keys: Sequence[str] = INSERT_KEYS,
    partitions: int = PARTITIONS,
    vectors: DataFrame | None = None,
) -> DataFrame:
    """Add the rows of ``vector_rows`` that a table does not hold; returns the table.

    New rows are placed by the table's centroids and coded by its ranges, their
    ids and numbers follow the largest held; their words and totals are counted
    alone and stand beside the held ones, so the cost is that of the new rows and
    of the key columns. All of it is seen in one step at the end; a call that
    failed may be repeated. A table that does not exist yet is made of the rows.
    """
    number, loads = published(spark, target)
    if not loads:
        rows = placed_rows(rows)
        return rows.drop("row_no") if rows.isEmpty() else replace(spark, rows, target, partitions, vectors)
    held = open_lines(spark, target)
    most = open_loads(spark, target, NUMBERS, loads).agg(F.max("row_no")).first()[0]
    added = placed_rows(new_rows(held, rows, keys), 0 if most is None else most + 1)
    if not added.isEmpty():
        last = held.agg(F.max("id")).first()[0]
        ids = (F.col("id") + F.lit(0 if last is None else last + 1)).cast(held.schema["id"].dataType)
        load = uuid.uuid4().hex
        _write_load(spark, added.withColumn("id", ids), target, load, *_places(spark, target, loads))
        _write_vectors(spark, target, load, vectors)
        publish(spark, target, [*loads, load], number)
    return open_lines(spark, target)


def upsert(
    spark: SparkSession,
    rows: DataFrame,
    target: str,
    keys: Sequence[str] = UPSERT_KEYS,
    partitions: int = PARTITIONS,
) -> DataFrame:
    """Put the rows of ``vector_rows`` into a table, in place of those with equal ``keys``; returns the table.

    The table is written anew beside the old one and takes its place in one step.
    """
    _, loads = published(spark, target)
    if loads:
        held = fitted(open_lines(spark, target), vector_table())
        rows = merged(held, fitted(rows, vector_table()), keys)
    return replace(spark, rows, target, partitions)


def _places(spark: SparkSession, target: str, loads: Sequence[str]) -> tuple[ivf.Centroids, ivf.Quantizer]:
    """The partitions and code ranges of a table; its first load has them."""
    centroids = ivf.Centroids.from_frame(open_loads(spark, target, CENTROIDS, loads[:1]), unit=True)
    return centroids, ivf.Quantizer.from_frame(open_loads(spark, target, RANGES, loads[:1]), unit=True)


def open_lines(spark: SparkSession, target: str) -> DataFrame:
    """The lines of a table's current version."""
    _, loads = published(spark, target)
    if not loads:
        raise FileNotFoundError(f"no table at {target}")
    return open_loads(spark, target, LINES, loads)


def search_index(spark: SparkSession, target: str, nprobes: int = PROBES, factor: int = REFINE_FACTOR):
    """A search over the probed partitions' codes, re-ranked with full vectors.

    Takes the place of the exact search wherever one is expected.
    """
    centroids, quantizer = _places(spark, target, published(spark, target)[1])

    def search(table, queries, k=NEIGHBOURS, **options):
        return ivf.refined_nearest(
            table, quantizer, queries, k, factor, centroids=centroids, nprobes=nprobes, **options
        )

    return search


def search_words(
    spark: SparkSession, target: str, queries: DataFrame, k: int = NEIGHBOURS, column: str = "content"
) -> DataFrame:
    """Keyword search over the stored postings of a column; reads the buckets of the terms asked."""
    _, loads = published(spark, target)
    return search_blocks(
        open_loads(spark, target, blocks_name(column), loads, BLOCKS),
        open_loads(spark, target, totals_name(column), loads),
        open_loads(spark, target, NUMBERS, loads),
        queries,
        k,
        KEY,
    )


def query(
    table: DataFrame,
    queries: DataFrame,
    embedder: Embedder,
    mode: str = "nearest",
    k: int = NEIGHBOURS,
    cap: int | None = None,
    **options,
) -> DataFrame:
    """Content for each query text ``(query_id, text)``; all queries are answered."""
    if mode == "all":
        return R.retrieve(table, queries, mode, k, cap)
    asked = checkpointed(R.query_vectors(queries, embedder).select("query_id", "vector"))
    return R.retrieve(table, asked, mode, k, cap, **options)


def prompt_batch(
    queries: DataFrame,
    system: str,
    model: str,
    context: DataFrame | None = None,
    settings: Column | None = None,
) -> DataFrame:
    """One request body per query; a query without context gets an empty one."""
    if context is None:
        asked = queries.withColumn("context", F.lit(None).cast("string"))
    else:
        asked = queries.join(context, "query_id", "left")
    said = P.messages(F.lit(system), P.contents(F.col("context")), F.col("text"))
    return asked.withColumn("body", P.request_body(model, said, settings))


def answered(
    bodies: DataFrame, start: Callable[[], Generator], strict: bool = False, json_only: bool = False
) -> DataFrame:
    """Requests with their replies, parsed; ``json_only`` fails on other answers."""
    replies = generate(bodies, start, strict=strict)
    parsed = replies.withColumn("parsed", parse_reply(F.col("reply")))
    answer = reply_text(F.col("parsed"))
    return parsed.withColumn("answer", checked_json(answer) if json_only else answer)


def rag_batch(
    table: DataFrame,
    queries: DataFrame,
    embedder: Embedder,
    system: str,
    model: str,
    start: Callable[[], Generator] | None = None,
    mode: str = "nearest",
    k: int = NEIGHBOURS,
    cap: int | None = None,
    **options,
) -> DataFrame:
    """Retrieve, build one request per query and, with a generator, answer it.

    In mode ``all`` the context is one text, so the caller has to say how many
    lines of the table it takes.
    """
    if mode == "all":
        if cap is None:
            raise ValueError("a context of the whole table needs a cap")
        whole = R.context_string(
            query(table, queries, embedder, mode, k, cap).withColumn("query_id", F.lit(0)),
            order=KEY,
        )
        text = whole.select("context").scalar()
        bodies = prompt_batch(
            queries, system, model, queries.select("query_id").withColumn("context", text),
            P.chat_options(),
        )
    else:
        found = query(table, queries, embedder, mode, k, cap, **options)
        order = ["rank"] if "rank" in found.columns else KEY
        context = R.context_string(found, order=order)
        bodies = prompt_batch(queries, system, model, context, P.chat_options())
    return bodies if start is None else answered(bodies, start)


def prompt_only(
    prompts: DataFrame, system: str, model: str, start: Callable[[], Generator] | None = None
) -> DataFrame:
    """Requests from prompts ``(query_id, text)`` without retrieval."""
    bodies = prompt_batch(prompts, system, model)
    return bodies if start is None else answered(bodies, start)
