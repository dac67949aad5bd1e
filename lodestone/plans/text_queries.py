"""Queries over documents, pages and log lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.text import base_name, extension, language_of
from lodestone.operators import blocks as K
from lodestone.operators import chunks as C
from lodestone.operators import lines as L
from lodestone.operators import postings as X
from lodestone.plans.registry import registered, rounded, table, wide_table
from lodestone.session import checkpointed, scratch_path
from lodestone.sources.files import read_ended_lines, read_files, read_lines

CAP, OVERLAP = 2048, 256


def lines_sql(text: str, source: str, keep: str) -> str:
    """Numbered lines of a text column."""
    parts = f"string_split_regex({text}, '\\r?\\n')"
    kept = f"CASE WHEN {parts}[-1] = '' THEN list_slice({parts}, 1, -2) ELSE {parts} END"
    return f"""SELECT {keep}, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no
      FROM (SELECT {keep}, {kept} AS ls FROM {source})"""


def chunks_sql(blocks: str, key: str, tail: str) -> str:
    """Chunks of texts given as lists of blocks, packed one chunk per step.

    ``blocks`` selects ``(key, bs)``; ``tail`` selects from ``chunk(key, chunk_number, chunk)``.
    """
    return rf"""WITH RECURSIVE
    u0 AS (SELECT {key}, unnest(bs) AS u, generate_subscripts(bs, 1) AS a FROM ({blocks})),
    u1 AS (SELECT {key}, a, unnest(x) AS u, generate_subscripts(x, 1) AS b FROM (
      SELECT {key}, a, CASE WHEN length(u) > {CAP}
        THEN regexp_extract_all(u, '[^\n]*\n|[^\n]+') ELSE [u] END AS x FROM u0)),
    u2 AS (SELECT {key}, a, b, unnest(x) AS u, generate_subscripts(x, 1) AS c FROM (
      SELECT {key}, a, b, CASE WHEN length(u) > {CAP}
        THEN regexp_extract_all(u, '(?s).+?(?:[.!?]+[ \t\r\n]+|\z)') ELSE [u] END AS x FROM u1)),
    u3 AS (SELECT {key}, a, b, c, unnest(x) AS u, generate_subscripts(x, 1) AS d FROM (
      SELECT {key}, a, b, c, CASE WHEN length(u) > {CAP}
        THEN regexp_extract_all(u, '[^ \t\r\n]+[ \t\r\n]*|[ \t\r\n]+') ELSE [u] END AS x FROM u2)),
    u4 AS (SELECT {key}, a, b, c, d, unnest(x) AS u, generate_subscripts(x, 1) AS e FROM (
      SELECT {key}, a, b, c, d, list_transform(range(0, CAST(ceil(length(u) / {CAP}) AS BIGINT)),
        lambda i: substr(u, i * {CAP} + 1, {CAP})) AS x FROM u3)),
    unit AS (SELECT {key}, u, row_number() OVER (PARTITION BY {key} ORDER BY a, b, c, d, e) AS i
             FROM u4),
    sized AS (SELECT {key}, u, i, sum(length(u)) OVER (PARTITION BY {key} ORDER BY i) AS s FROM unit),
    doc AS (SELECT {key}, list(u ORDER BY i) AS us, list_prepend(0, list(s ORDER BY i)) AS t,
                   CAST(count(*) AS BIGINT) AS n FROM sized GROUP BY {key}),
    span AS (
      SELECT {key}, t, n, CAST(0 AS BIGINT) AS f,
        list_max(list_filter(range(1, n + 1), lambda p: t[p + 1] <= {CAP})) AS p
      FROM doc
      UNION ALL
      SELECT {key}, t, n, j AS f,
        list_max(list_filter(range(p + 1, n + 1), lambda x: t[x + 1] - t[j + 1] <= {CAP})) AS p
      FROM (SELECT {key}, t, n, p, list_min(list_filter(range(f + 1, p + 1),
              lambda x: t[p + 1] - t[x + 1] <= {OVERLAP} AND t[p + 2] - t[x + 1] <= {CAP})) AS j
            FROM span WHERE p < n)),
    cut AS (SELECT {key}, f, regexp_replace(array_to_string(list_slice(us, f + 1, p), ''),
              '^\s+|\s+$', '', 'g') AS chunk
            FROM span JOIN doc USING ({key})),
    chunk AS (SELECT {key}, chunk,
                row_number() OVER (PARTITION BY {key} ORDER BY f) - 1 AS chunk_number
              FROM cut WHERE chunk <> '')
    {tail}"""


def packed_sql(blocks: str, key: str, tail: str) -> str:
    """As ``chunks_sql``, for texts of many units: where a chunk ends and the next begins is joined, not searched."""
    units = chunks_sql(blocks, key, "").split("sized AS")[0]
    return rf"""{units}
    b AS MATERIALIZED (SELECT {key}, i, u, length(u) AS l,
            sum(length(u)) OVER (PARTITION BY {key} ORDER BY i) - length(u) AS s FROM unit),
    bound AS (SELECT {key}, i, s FROM b UNION ALL SELECT {key}, max(i) + 1, max(s + l) FROM b GROUP BY {key}),
    ends AS (SELECT b.{key}, b.i, e.i AS p FROM b ASOF JOIN bound e ON b.{key} = e.{key} AND b.s + {CAP} >= e.s),
    room AS (SELECT x.{key}, x.i, x.p, y.s - least({OVERLAP}, {CAP} - y.l) AS t
             FROM ends x LEFT JOIN b y ON x.{key} = y.{key} AND x.p = y.i),
    nxt AS MATERIALIZED (SELECT r.{key}, r.i, r.p, greatest(r.i + 1, e.i) AS j
            FROM (SELECT * FROM room WHERE t IS NOT NULL) r ASOF JOIN b e ON r.{key} = e.{key} AND r.t <= e.s
            UNION ALL SELECT {key}, i, p, NULL FROM room WHERE t IS NULL),
    span AS (SELECT {key}, i, p, j FROM nxt WHERE i = 1
             UNION ALL SELECT m.{key}, m.i, m.p, m.j FROM span JOIN nxt m ON m.{key} = span.{key} AND m.i = span.j),
    cut AS (SELECT x.{key}, x.f, regexp_replace(string_agg(b.u, '' ORDER BY b.i), '^\s+|\s+$', '', 'g') AS chunk
            FROM (SELECT {key}, i AS f, unnest(range(i, p)) AS i FROM span) x
            JOIN b ON b.{key} = x.{key} AND b.i = x.i GROUP BY x.{key}, x.f),
    chunk AS (SELECT {key}, chunk, row_number() OVER (PARTITION BY {key} ORDER BY f) - 1 AS chunk_number
              FROM cut WHERE chunk <> '')
    {tail}"""


TEXT_BLOCKS = r"SELECT doc_id, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS bs FROM documents"


@registered(lines_sql("text", "documents", "doc_id"))
def line_split(spark, folder):
    return L.explode_lines(wide_table(spark, folder, "documents"), "text", ["doc_id"])


@registered(
    f"""SELECT doc_id, c AS chunk_number, substr(text, c * {CAP - OVERLAP} + 1, {CAP}) AS chunk
    FROM (SELECT doc_id, text, unnest(range(0, greatest(1,
            CAST(ceil((length(text) - {OVERLAP}) / {CAP - OVERLAP}) AS BIGINT)))) AS c
          FROM documents WHERE length(text) > 0)"""
)
def chunk_fixed(spark, folder):
    return C.chunk_fixed(wide_table(spark, folder, "documents"), "text", ["doc_id"], CAP, OVERLAP)


@registered(chunks_sql(TEXT_BLOCKS, "doc_id", "SELECT doc_id, chunk_number, chunk FROM chunk"))
def chunk_text(spark, folder):
    return C.chunk_text(wide_table(spark, folder, "documents"), "text", ["doc_id"], CAP, OVERLAP)


TAGS = r"<(?:p|div|ul|h[1-6]|table|nav|footer|article|section)[ >]"


@registered(
    chunks_sql(
        f"""SELECT page_id, list_filter(string_split(
              regexp_replace(html, '({TAGS})', chr(1) || '\\1', 'g'), chr(1)),
              lambda x: x <> '') AS bs FROM pages""",
        "page_id",
        "SELECT page_id, chunk_number, chunk FROM chunk",
    )
)
def chunk_code(spark, folder):
    """Breaks where an element starts, as source code breaks at declarations."""
    pages = wide_table(spark, folder, "pages")
    return C.chunk_text(pages, "html", ["page_id"], CAP, OVERLAP, f"(?={TAGS})")


@registered(
    chunks_sql(
        TEXT_BLOCKS,
        "doc_id",
        """SELECT doc_id, chunk_number,
             CAST(row_number() OVER (ORDER BY doc_id, chunk_number) - 1 AS BIGINT) AS id
           FROM chunk""",
    )
)
def chunk_global_id(spark, folder):
    chunks = C.chunk_text(wide_table(spark, folder, "documents"), "text", ["doc_id"], CAP, OVERLAP)
    stored = checkpointed(chunks.select("doc_id", "chunk_number"))
    numbered = C.number_chunks(stored, "doc_id", F.floor(F.col("doc_id") / 4096))
    return numbered.select("doc_id", "chunk_number", "id")


def event_lines(spark, folder):
    """Events as log lines of their user."""
    line = F.concat_ws(" ", "event_type", "props")
    return table(spark, folder, "events").select("user_id", "event_id", "ts", line.alias("line"))


def _numbered_events(spark, folder):
    return L.drop_noise(
        event_lines(spark, folder), "user_id", "ts", F.date_trunc("day", "ts"), ["VIEW"]
    )


EVENT_LINES = """
    k AS (
      SELECT user_id, event_id, line, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS n
      FROM (SELECT *, event_type || ' ' || props AS line FROM events)
      WHERE NOT contains(lower(line), 'view'))"""
HITS = "(contains(lower(line), 'error') OR contains(lower(line), 'exception'))"


@registered(f"WITH {EVENT_LINES} SELECT user_id, event_id, line, n FROM k")
def log_noise_filter(spark, folder):
    return _numbered_events(spark, folder).select("user_id", "event_id", "line", "n")


@registered(
    f"""WITH {EVENT_LINES}, h AS (SELECT user_id, n AS hit_n FROM k WHERE {HITS})
    SELECT k.user_id, h.hit_n, k.n, k.event_id, k.line FROM h JOIN k
      ON k.user_id = h.user_id AND k.n BETWEEN h.hit_n - 20 AND h.hit_n + 20
    WHERE trim(k.line) <> ''"""
)
def log_context(spark, folder):
    found = L.error_context(_numbered_events(spark, folder), "user_id")
    return found.select("user_id", "hit_n", "n", "event_id", "line")


@registered(
    f"""WITH {EVENT_LINES}, w AS (
      SELECT *, max({HITS}::INT) OVER (PARTITION BY user_id ORDER BY n
        ROWS BETWEEN 20 PRECEDING AND 20 FOLLOWING) AS near FROM k)
    SELECT user_id, n, event_id, line FROM w WHERE near = 1"""
)
def log_context_dedupe(spark, folder):
    found = L.error_context(_numbered_events(spark, folder), "user_id", dedupe=True)
    return found.select("user_id", "n", "event_id", "line")


@registered(
    f"""WITH l AS ({lines_sql("text", "documents", "doc_id")})
    SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text
    FROM l WHERE trim(line) <> '' GROUP BY doc_id"""
)
def join_lines(spark, folder):
    lines = L.explode_lines(wide_table(spark, folder, "documents"), "text", ["doc_id"])
    return L.join_lines(L.drop_blank(lines), "doc_id")


LOG_CHUNKS = chunks_sql(
    f"""WITH {EVENT_LINES}, h AS (SELECT user_id, n AS hit_n FROM k WHERE {HITS})
    SELECT k.user_id, list(k.line || chr(10) ORDER BY h.hit_n, k.n) AS bs FROM h JOIN k
      ON k.user_id = h.user_id AND k.n BETWEEN h.hit_n - 20 AND h.hit_n + 20
    WHERE trim(k.line) <> '' GROUP BY k.user_id""",
    "user_id",
    "SELECT user_id, chunk_number, chunk FROM chunk",
)


@registered(LOG_CHUNKS)
def log_chunks(spark, folder):
    """Each user's events as one log file, cut down to its error context and chunked."""
    files = L.join_lines(
        event_lines(spark, folder), "user_id", ["ts"], F.date_trunc("day", "ts")
    )
    context = L.error_text(F.col("text"), noise=["VIEW"])
    return C.chunk_lines(files, context, ["user_id"], CAP, OVERLAP)


@registered(LOG_CHUNKS)
def log_chunks_by_rows(spark, folder):
    """The same chunks without ever holding a log as one value."""
    context = L.error_context(_numbered_events(spark, folder), "user_id")
    return C.chunk_log(context, "user_id", [], CAP, OVERLAP)


@registered(
    packed_sql(
        f"""WITH k AS (
          SELECT line, row_number() OVER (ORDER BY ts) - 1 AS n
          FROM (SELECT *, event_type || ' ' || props AS line FROM events)
          WHERE NOT contains(lower(line), 'view')),
        h AS (SELECT n AS hit_n FROM k WHERE {HITS})
        SELECT 'events' AS file, list(k.line || chr(10) ORDER BY h.hit_n, k.n) AS bs
        FROM h JOIN k ON k.n BETWEEN h.hit_n - 20 AND h.hit_n + 20 WHERE trim(k.line) <> ''""",
        "file",
        "SELECT file, chunk_number, chunk FROM chunk",
    )
)
def log_chunks_long(spark, folder):
    """All events as one log, by rows, whatever its number of hits and lines."""
    lines = event_lines(spark, folder).withColumn("file", F.lit("events"))
    numbered = L.drop_noise(lines, "file", "ts", F.date_trunc("day", "ts"), ["VIEW"])
    return C.chunk_log(L.error_context(numbered, "file"), "file", [], CAP, OVERLAP)


@registered(
    packed_sql(
        r"""SELECT source, regexp_extract_all(string_agg(text || chr(10), '' ORDER BY doc_id),
              '[^\n]*\n|[^\n]+') AS bs FROM documents GROUP BY source""",
        "source",
        "SELECT source, chunk_number, chunk FROM chunk",
    )
)
def text_chunks_by_rows(spark, folder):
    """The documents of a source as one text file, read in splits and chunked without being one value."""
    path = scratch_path(spark, "sources")
    documents = table(spark, folder, "documents").select("source", "doc_id", "text")
    dealt = documents.repartition("source").sortWithinPartitions("source", "doc_id")
    dealt.select("source", "text").write.partitionBy("source").text(path)
    lines = read_ended_lines(spark, path, ["text"]).withColumn(
        "source", F.regexp_extract("path", "source=([^/]*)/", 1)
    )
    return C.chunk_rows(lines, "source", ["block", "row"], F.col("block"), [], CAP, OVERLAP)


#: Source text made of a part, by language; K, N and S stand for its key, name and size.
PART_CODE = {
    "rust": "/// N\npub fn part_K() -> u32 {\n    S\n}\n",
    "python": "@part\ndef part_K():\n    # N\n    return S\n",
    "java": "    /* N */\n    public int partK() {\n        return S;\n    }\n",
    "javascript": "// N\nexport function partK() {\n  return S;\n}\n",
    "typescript": "// N\nexport interface partK {\n  size: S;\n}\n",
    "tsx": "// N\nexport const partK = () => <p>S</p>;\n",
    "go": "// N\nfunc partK() int {\n\treturn S\n}\n",
    "scala": "  // N\n  case object partK {\n    val size = S\n  }\n",
    "c": "/* N */\nint part_K(void)\n{\n    return size(S);\n}\n",
    "cpp": "// N\nnamespace parts {\nint part_K(int a)\n{\n    return a + S;\n}\n}\n",
}


def _code_sql() -> str:
    made, marks = [], []
    for number, (language, code) in enumerate(PART_CODE.items()):
        text = code.replace("\n", "\\n").replace("\t", "\\t")
        made.append(f"WHEN {number} THEN E'{text}'")
        body = C.DECLARATIONS[language].removeprefix("(?m)(?=").removesuffix(")").replace("[^;]*$", "[^;\\n]*$")
        marks.append(f"WHEN '{language}' THEN regexp_replace(text, '(?m){body}', chr(1) || '\\0', 'g')")
    names = ", ".join(f"'{name}'" for name in PART_CODE)
    return packed_sql(
        f"""WITH made AS (SELECT ([{names}])[p_partkey % 10 + 1] AS language, p_type, p_partkey,
              replace(replace(replace(CASE p_partkey % 10 {" ".join(made)} END,
                'K', p_partkey::VARCHAR), 'N', p_name), 'S', p_size::VARCHAR) AS code FROM part),
            files AS (SELECT language || '/' || p_type AS file, language,
              string_agg(code, chr(10) ORDER BY p_partkey) AS text FROM made GROUP BY language, p_type)
            SELECT file, list_filter(string_split(CASE language {" ".join(marks)} END, chr(1)),
              lambda x: x <> '') AS bs FROM files""",
        "file",
        "SELECT file, chunk_number, chunk FROM chunk",
    )


def _part_code(spark, folder):
    """Rows ``file, language, p_partkey, code``: every part as a declaration in one of ten languages."""
    parts = table(spark, folder, "part")
    which = F.expr(f"CAST(p_partkey % {len(PART_CODE)} + 1 AS INT)")
    language = F.element_at(F.array(*map(F.lit, PART_CODE)), which)
    code = F.element_at(F.array(*map(F.lit, PART_CODE.values())), which)
    for letter, value in (("K", "p_partkey"), ("N", "p_name"), ("S", "p_size")):
        code = F.replace(code, F.lit(letter), F.col(value).cast("string"))
    file = F.concat(language, F.lit("/"), "p_type")
    return parts.select(file.alias("file"), language.alias("language"), "p_partkey", code.alias("code"))


@registered(_code_sql())
def code_chunks(spark, folder):
    """Source files in ten languages, one value each, chunked at declarations."""
    part = F.floor(F.col("p_partkey") / 4096)
    files = L.join_lines(_part_code(spark, folder), "file", ["p_partkey"], part, "code")
    files = files.withColumn("language", F.split("file", "/")[0])
    return C.chunk_code(files, keep=["file"], cap=CAP, overlap=OVERLAP)


@registered(_code_sql())
def code_chunks_by_rows(spark, folder):
    """The same files line by line, none of them ever one value."""
    made = _part_code(spark, folder)
    # every part of a file but its last is followed by an empty line
    last = made.groupBy("file").agg(F.max("p_partkey").alias("_last"))
    more = F.col("p_partkey") < F.col("_last")
    made = made.join(last, "file").withColumn(
        "code", F.when(more, F.concat("code", F.lit("\n"))).otherwise(F.col("code"))
    )
    cut = F.regexp_extract_all("code", F.lit(C.LINE), F.lit(0))
    lines = made.select("file", "language", "p_partkey", F.posexplode(cut).alias("n", "line"))
    part, boundary = F.floor(F.col("p_partkey") / 4096), C.declaration_start(F.col("language"))
    return C.chunk_rows(lines, "file", ["p_partkey", "n"], part, [], CAP, OVERLAP, boundary)


PATHS = """'/data/' || source || '/f' || doc_id || '.' || CASE lang
      WHEN 'en' THEN 'txt' WHEN 'fr' THEN 'rs' WHEN 'de' THEN 'PY' ELSE 'h' END"""


@registered(
    f"""SELECT doc_id, 'f' || doc_id || '.' || e AS metadata,
      CASE e WHEN 'txt' THEN 'text' WHEN 'rs' THEN 'rust' ELSE 'c' END AS language
    FROM (SELECT doc_id, regexp_extract({PATHS}, '[^/]\\.([^./]+)$', 1) AS e FROM documents)
    WHERE e IN ('txt', 'rs', 'h')"""
)
def file_types(spark, folder):
    """Type filter and base names over paths made from the documents."""
    documents = table(spark, folder, "documents").withColumn("path", F.expr(PATHS))
    typed = documents.withColumn("language", language_of(F.col("path")))
    return typed.where(F.col("language").isNotNull()).select(
        "doc_id", base_name(F.col("path")).alias("metadata"), "language"
    )


@registered(
    """SELECT page_id, coalesce(nullif(string_split(url, '/')[-1], ''), 'None') AS metadata,
      regexp_extract(url, '[^/]\\.([^./]+)$', 1) AS extension FROM pages"""
)
def base_names(spark, folder):
    return table(spark, folder, "pages").select(
        "page_id",
        base_name(F.col("url")).alias("metadata"),
        extension(F.col("url")).alias("extension"),
    )


def _written_documents(spark, folder) -> str:
    """The documents as text files in one folder per source; returns the path."""
    path = scratch_path(spark, "documents")
    documents = wide_table(spark, folder, "documents").select("source", "text")
    documents.write.partitionBy("source").option("maxRecordsPerFile", 100_000).text(path)
    return path


FILE_LINES = f"""WITH l AS ({lines_sql("text || chr(10)", "documents", "doc_id, source")})
    SELECT source, line, count(*) AS lines FROM l GROUP BY source, line"""


@registered(FILE_LINES)
def file_load(spark, folder):
    """Text files written from the documents, found again and read whole."""
    files = read_files(spark, _written_documents(spark, folder))
    source = F.regexp_extract("path", "source=([^/]+)/", 1)
    lines = L.explode_lines(files.withColumn("source", source), "text", ["source"])
    return lines.groupBy("source", "line").agg(F.count(F.lit(1)).alias("lines"))


@registered(FILE_LINES)
def file_lines(spark, folder):
    """The same files read line by line, split over tasks."""
    lines = read_lines(spark, _written_documents(spark, folder))
    source = F.regexp_extract("path", "source=([^/]+)/", 1).alias("source")
    return lines.select(source, "line").groupBy("source", "line").agg(
        F.count(F.lit(1)).alias("lines")
    )


def _terms_sql(text: str, source: str, key: str) -> str:
    return f"""
    w AS (SELECT {key}, regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+') AS ws FROM {source}),
    t AS (SELECT {key}, unnest(ws) AS term, generate_subscripts(ws, 1) - 1 AS pos FROM w),
    p AS (SELECT {key}, term, count(*) AS tf, min(pos) AS first_pos, max(pos) AS last_pos
          FROM t GROUP BY {key}, term)"""


def _shown_postings(index, key):
    return index.select(
        key,
        "term",
        "tf",
        F.element_at("positions", 1).alias("first_pos"),
        F.element_at("positions", -1).alias("last_pos"),
    )


@registered(
    f"""WITH {_terms_sql("text", "documents", "doc_id")}
    SELECT doc_id, term, tf, first_pos, last_pos FROM p"""
)
def postings(spark, folder):
    documents = wide_table(spark, folder, "documents")
    return _shown_postings(X.postings(documents, "text", "doc_id"), "doc_id")


@registered(
    f"""WITH {_terms_sql("url", "pages", "page_id")}
    SELECT page_id, term, tf, first_pos, last_pos FROM p"""
)
def postings_url(spark, folder):
    pages = wide_table(spark, folder, "pages")
    return _shown_postings(X.postings(pages, "url", "page_id"), "page_id")


@registered(
    f"""WITH {_terms_sql("text", "documents", "doc_id")}
    SELECT term, count(*) AS row_count, CAST(sum(tf) AS BIGINT) AS occurrences FROM p GROUP BY term"""
)
def term_stats(spark, folder):
    documents = table(spark, folder, "documents")
    return X.term_stats(X.term_counts(documents, "text", "doc_id"))


RANKED = f"""WITH {_terms_sql("text", "documents", "doc_id")},
    c AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM w),
    f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    q AS (SELECT DISTINCT item_id AS query_id,
            unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM benchmark),
    s AS (SELECT q.query_id, p.doc_id, round(sum(
            ln(1 + (c.n - f.df + 0.5) / (f.df + 0.5)) * p.tf * 2.2
            / (p.tf + 1.2 * (1 - 0.75 + 0.75 * len(w.ws) / c.mean))), 9) AS score
          FROM q JOIN f USING (term) JOIN p USING (term) JOIN w USING (doc_id) CROSS JOIN c
          GROUP BY q.query_id, p.doc_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
          FROM s)
    SELECT query_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10"""


@registered(RANKED)
def bm25(spark, folder):
    documents = table(spark, folder, "documents")
    index = checkpointed(X.term_counts(documents, "text", "doc_id"))
    stats = X.term_stats(index)
    queries = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    corpus = X.corpus_stats(documents, "text", stats)
    found = X.keyword_search(index, stats, corpus, queries, 10, "doc_id")
    return found.select("query_id", "doc_id", rounded("score", "score"), "rank")


def _blocks(spark, folder):
    """The documents, their numbers and their words in blocks."""
    documents = K.placed_rows(table(spark, folder, "documents").select("doc_id", "text"))
    return documents, documents.select("doc_id", "row_no"), K.blocks_of(documents.select("row_no", "text"))


@registered(RANKED)
def bm25_blocks(spark, folder):
    """The same ranking from postings in blocks, of which only those are expanded that may matter."""
    documents, rows, blocks = _blocks(spark, folder)
    target = scratch_path(spark, "blocks")
    blocks.write.option("compression", "zstd").partitionBy("bucket").parquet(target)
    blocks = spark.read.parquet(target)
    queries = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    totals = K.text_totals(documents.where("text IS NOT NULL"), blocks)
    found = K.search_blocks(blocks, totals, rows, queries, 10, ["doc_id"])
    return found.select("query_id", "doc_id", rounded("score", "score"), "rank")


@registered(
    f"""WITH {_terms_sql("text", "documents", "doc_id")}
    SELECT doc_id, term, tf, first_pos, last_pos FROM p"""
)
def postings_blocks(spark, folder):
    """The postings of the documents, expanded from their blocks."""
    _, rows, blocks = _blocks(spark, folder)
    return _shown_postings(K.keyed_postings(blocks, rows, ["doc_id"]), "doc_id")
