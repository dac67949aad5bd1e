import os
import subprocess
import sys

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lodestone.operators.chunks import chunk_files
from lodestone.operators import retrieve as R
from lodestone.operators.embedding import FunctionEmbedder, HashingEmbedder
from lodestone.operators.lines import drop_noise
from lodestone.operators.generation import stub_generator
from lodestone.plans import jobs
from lodestone.schema import vector_table
from lodestone.session import checkpointed, scratch_path
from lodestone.sources import files as S
from lodestone.sources import tables as B
from lodestone.streaming.loads import arriving_files, insert_stream

EMBEDDER = HashingEmbedder(64)


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "y" / "deep").mkdir(parents=True)
    texts = {
        "a.rs": "fn main() {\n    start_engine();\n}\n",
        "b.RS": "skipped",
        "c.h": "int count(void);\n",
        "e": "no extension",
        "x/mod.rs": "mod apples;\n\nfn pick() {}\n",
        "y/deep/mod.rs": "mod pears;\n",
        "notes.txt": "Temperature controls randomness.\nMirostat controls perplexity.\n",
        "run.log": "\n".join(["start"] * 3 + ["Lineage of x", "ERROR disk full"] + ["more"] * 30),
        "quiet.log": "nothing here",
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "d.png").write_bytes(b"\xff\xfe\x00")
    return tmp_path


def test_files(spark, folder):
    found = {r.path.split(str(folder))[1]: r for r in S.read_files(spark, str(folder)).collect()}
    assert sorted(found) == sorted(
        ["/a.rs", "/c.h", "/x/mod.rs", "/y/deep/mod.rs", "/notes.txt", "/run.log", "/quiet.log"]
    )
    assert found["/x/mod.rs"].metadata == "mod.rs" and found["/c.h"].language == "c"
    assert S.read_files(spark, str(folder / "a.rs")).count() == 1
    with pytest.raises(PySparkException):
        S.read_files(spark, str(folder / "missing")).count()


def test_bytes_that_are_no_text(spark, folder):
    (folder / "bad.txt").write_bytes(b"ab\xff")
    with pytest.raises(PySparkException):
        S.read_files(spark, str(folder)).collect()
    assert S.read_files(spark, str(folder), strict=False).count() == 7


def test_lines_and_prompts(spark, folder):
    (folder / "crlf.txt").write_bytes(b"a\r\nb\r\n")
    (folder / "bad.log").write_bytes(b"fine\nab\xff\n")
    with pytest.raises(PySparkException):
        S.read_lines(spark, str(folder), "*.log").collect()
    logs = S.read_lines(spark, str(folder), "*.log", strict=False)
    assert {r.metadata for r in logs.collect()} == {"run.log", "quiet.log"}
    lines = S.read_lines(spark, str(folder / "crlf.txt")).collect()
    assert [(r.metadata, r.line) for r in lines] == [("crlf.txt", "a"), ("crlf.txt", "b")]
    assert S.read_prompt(spark, str(folder / "notes.txt")).startswith("Temperature")
    with pytest.raises(Exception):
        S.read_prompt(spark, str(folder / "none.txt"))


def test_table_names():
    assert B.table_location("/r/", "/home/scripts/") == "/r/scripts_db/scripts_table"


@pytest.fixture()
def loaded(spark, folder):
    target = B.table_location(scratch_path(spark, "db"), str(folder))
    return jobs.load(spark, str(folder), target, EMBEDDER, partitions=4), target


def test_load_and_query(spark, loaded):
    table, target = loaded
    assert {f.name for f in vector_table()} <= set(table.columns)
    rows = table.collect()
    assert len({(r.path, r.chunk_number, r.line_no) for r in rows}) == len(rows)
    assert sorted({r.id for r in rows}) == list(range(len({(r.path, r.chunk_number) for r in rows})))
    log = [r.content for r in sorted(rows, key=lambda r: r.line_no) if r.metadata == "run.log"]
    assert log == ["start"] * 3 + ["ERROR disk full"] + ["more"] * 20
    assert not [r for r in rows if r.metadata == "quiet.log"]

    queries = spark.createDataFrame(
        [("q", "temperature randomness"), ("p", "pears"), ("e", "  ")], "query_id string, text string"
    )
    found = jobs.query(table, queries, EMBEDDER, k=1).collect()
    assert {r.query_id: r.content for r in found} == {
        "q": "Temperature controls randomness.", "p": "mod pears;",
    }
    search = jobs.search_index(spark, target)
    indexed = jobs.query(table, queries, EMBEDDER, k=3, search=search).collect()
    exact = jobs.query(table, queries, EMBEDDER, k=3).collect()
    top = lambda rows: sorted((r.query_id, r["rank"], round(r._distance, 6)) for r in rows)
    assert top(indexed) == top(exact)

    files = jobs.query(table, queries, EMBEDDER, "file", k=1, file="metadata").where("query_id = 'p'")
    assert [r.content for r in files.orderBy(*jobs.KEY).collect()] == ["mod apples;", "", "fn pick() {}", "mod pears;"]
    files = jobs.query(table, queries, EMBEDDER, "file", k=1).where("query_id = 'p'")
    assert [r.content for r in files.orderBy(*jobs.KEY).collect()] == ["mod pears;"]
    chunks = jobs.query(table, queries, EMBEDDER, "chunk", k=1, chunk=["path", "chunk_number"])
    assert [r.content for r in chunks.where("query_id = 'p'").collect()] == ["mod pears;"]
    everything = jobs.query(table, queries, EMBEDDER, "all", cap=5)
    assert everything.count() == 5 and "vector" not in everything.columns

    words = spark.createDataFrame([("w", "mirostat")], "query_id string, text string")
    assert [r.metadata for r in jobs.search_words(spark, target, words).join(
        table, ["path", "chunk_number", "line_no"]).collect()] == ["notes.txt"]
    named = jobs.search_words(spark, target, spark.createDataFrame([("w", "mod")], "query_id string, text string"), 10, "metadata")
    assert named.count() == table.where("metadata = 'mod.rs'").count()


def test_prompts_and_answers(spark, loaded):
    table, _ = loaded
    queries = spark.createDataFrame([("q", "temperature randomness")], "query_id string, text string")
    for mode, cap in (("nearest", None), ("file", None), ("file", 1000), ("all", 1000)):
        reply = jobs.rag_batch(table, queries, EMBEDDER, "S", "m", lambda: stub_generator, mode, 2, cap).first()
        assert reply.status == "ok" and "Temperature" in reply.context
        assert reply.answer == '{"characters": 22, "first": "temperature"}'
    with pytest.raises(ValueError):
        jobs.rag_batch(table, queries, EMBEDDER, "S", "m", mode="all", cap=None)
    body = jobs.prompt_only(queries, "S", "m").first().body
    assert '"content":""' in body and "options" not in body


def test_replacing_and_adding(spark, loaded, folder):
    table, target = loaded
    before = table.count()
    small = spark.createDataFrame([("/n/new.txt", "new.txt", "text", "one\ntwo")], "path string, metadata string, language string, text string")
    other = scratch_path(spark, "plain")
    B.create_table(spark, other)
    assert B.open_table(spark, other).count() == 0
    rows = jobs.vector_rows(chunk_files(small, ["path", "metadata"]), EMBEDDER)
    for _ in range(2):
        B.insert_rows(spark, other, rows)
        assert B.open_table(spark, other, vector_table()).count() == 2
    jobs.load(spark, small, target, EMBEDDER, partitions=1)
    assert jobs.open_lines(spark, target).count() == 2 and before > 2


def test_adding_to_a_loaded_table(spark):
    schema = "path string, metadata string, language string, text string"
    first = spark.createDataFrame([("/a/mod.rs", "mod.rs", "text", "one\ntwo\nthree"), ("/c/z.txt", "z.txt", "text", "four")], schema)
    second = spark.createDataFrame([("/b/mod.rs", "mod.rs", "text", "one\ntwo\nthree"), ("/c/z.txt", "z.txt", "text", "four")], schema)
    target = scratch_path(spark, "grown")
    jobs.load(spark, first, target, EMBEDDER, partitions=2)
    rows = checkpointed(jobs.vector_rows(chunk_files(second, ["path", "metadata"]), EMBEDDER))
    for _ in range(2):
        table = jobs.insert(spark, rows, target)
        assert sorted((r.path, r.content) for r in table.collect()) == sorted(
            [(p, w) for p in ("/a/mod.rs", "/b/mod.rs") for w in ("one", "two", "three")] + [("/c/z.txt", "four")]
        )
    assert table.where("codes IS NULL OR part IS NULL").isEmpty()
    ids = {r.path: r.id for r in table.collect()}
    assert ids["/b/mod.rs"] > max(ids["/a/mod.rs"], ids["/c/z.txt"])
    asked = spark.createDataFrame([(1, "two")], "query_id int, text string")
    words = jobs.search_words(spark, target, asked, 5)
    assert sorted(r.path for r in words.collect()) == ["/a/mod.rs", "/b/mod.rs"]
    near = jobs.query(table, asked, EMBEDDER, k=2, search=jobs.search_index(spark, target, 2))
    assert sorted((r.path, r.content) for r in near.collect()) == [("/a/mod.rs", "two"), ("/b/mod.rs", "two")]


def test_files_that_arrive(spark, folder):
    target, state = scratch_path(spark, "stream"), scratch_path(spark, "state")

    def run():
        writer = insert_stream(arriving_files(spark, str(folder)), target, EMBEDDER, state, partitions=2)
        query = writer.trigger(availableNow=True).start()
        assert query.awaitTermination(120)

    run()
    first = jobs.open_lines(spark, target).count()
    assert first > 0
    run()
    assert jobs.open_lines(spark, target).count() == first
    (folder / "later.txt").write_text("arrived later\n")
    run()
    table = jobs.open_lines(spark, target)
    added = table.where("metadata = 'later.txt'")
    assert [r.content for r in added.collect()] == ["arrived later"]
    assert table.count() == first + 1
    assert added.select(F.size("vector")).first()[0] == 64
    assert added.first().id > table.where("metadata <> 'later.txt'").agg(F.max("id")).first()[0]
    asked = spark.createDataFrame([(1, "arrived")], "query_id int, text string")
    assert [r.path for r in jobs.search_words(spark, target, asked, 5).collect()] == [added.first().path]


FILES = "path string, metadata string, language string, text string"


def test_a_failed_load_or_insert_changes_nothing(spark, monkeypatch):
    target = scratch_path(spark, "steps")
    one = spark.createDataFrame([("/a.txt", "a.txt", "text", "one\ntwo")], FILES)
    two = spark.createDataFrame([("/b.txt", "b.txt", "text", "three")], FILES)
    jobs.load(spark, one, target, EMBEDDER, partitions=1)
    asked = spark.createDataFrame([(1, "two three")], "query_id int, text string")

    def state():
        lines = sorted(r.content for r in jobs.open_lines(spark, target).collect())
        return lines, sorted(r.path for r in jobs.search_words(spark, target, asked, 5).collect())

    before = state()
    assert before == (["one", "two"], ["/a.txt"])
    rows = checkpointed(jobs.vector_rows(chunk_files(two, ["path", "metadata"]), EMBEDDER))
    real = jobs.index_words
    for broken in ("metadata", "content"):
        def fail(spark, rows, numbers, target, load, column):
            if column == broken:
                raise RuntimeError("lost")
            real(spark, rows, numbers, target, load, column)

        monkeypatch.setattr(jobs, "index_words", fail)
        for step in (lambda: jobs.load(spark, two, target, EMBEDDER, partitions=1), lambda: jobs.insert(spark, rows, target)):
            with pytest.raises(RuntimeError):
                step()
            assert state() == before
    monkeypatch.setattr(jobs, "index_words", real)
    jobs.insert(spark, rows, target)
    assert state() == (["one", "three", "two"], ["/a.txt", "/b.txt"])
    jobs.load(spark, two, target, EMBEDDER, partitions=1)
    assert state() == (["three"], ["/b.txt"])


def test_stored_upsert(spark):
    target = scratch_path(spark, "upserts")
    one = spark.createDataFrame([("/a.txt", "a.txt", "text", "one\ntwo"), ("/b.txt", "b.txt", "text", "three")], FILES)
    jobs.load(spark, one, target, EMBEDDER, partitions=1)
    rows = jobs.vector_rows(chunk_files(one.where("path = '/b.txt'"), ["path", "metadata"]), EMBEDDER)
    changed = rows.withColumn("content", F.lit("four")).withColumn("model", F.lit("other"))
    keys = ["path", "chunk_number", "line_no"]
    for _ in range(2):
        table = jobs.upsert(spark, changed, target, keys, partitions=1)
        assert sorted((r.content, r.model == "other") for r in table.collect()) == [("four", True), ("one", False), ("two", False)]
    asked = spark.createDataFrame([(1, "three"), (2, "four")], "query_id int, text string")
    assert [(r.query_id, r.path) for r in jobs.search_words(spark, target, asked, 5).collect()] == [(2, "/b.txt")]


CALLS = "calls.txt"


def test_distinct_lines_are_embedded_once(spark, tmp_path):
    """Model calls equal distinct lines, over loads too, and rows are as without."""
    log = str(tmp_path / CALLS)

    def start():
        def model(texts):
            with open(log, "a") as out:
                out.writelines(f"{len(t)}:{t}\n" for t in texts)
            return [[float(len(t)), 1.0] for t in texts]

        return model

    embedder = FunctionEmbedder(start, 2, "lengths")
    one = spark.createDataFrame([("/a", "a", "text", "x\nyy\nx\n\nx"), ("/b", "b", "text", "yy\nzzz")], FILES)
    two = spark.createDataFrame([("/c", "c", "text", "zzz\nx\nnew one\n\n" + "yy\n" * 4000)], FILES)
    target = scratch_path(spark, "distinct")
    jobs.load(spark, one, target, embedder, partitions=1)
    table = jobs.load_more(spark, two, target, embedder)
    said = sorted(open(log).read().splitlines())
    assert said == sorted(["1:x", "2:yy", "0:", "3:zzz", "7:new one"])
    rows = [(r.path, r.chunk_number, r.line_no, r.content, list(r.vector)) for r in table.collect()]
    plain = jobs.vector_rows(chunk_files(one.union(two), ["path", "metadata"]), embedder).collect()
    assert sorted(rows) == sorted((r.path, r.chunk_number, r.line_no, r.content, [float(len(r.content)), 1.0]) for r in plain)
    other = FunctionEmbedder(start, 2, "other model")
    jobs.load_more(spark, two, target, other)
    assert len(open(log).read().splitlines()) == 15


def test_context_of_large_files(spark, loaded, monkeypatch):
    """Lines and queries that meet by stretches of a file give what sending the queries gives."""
    table, _ = loaded
    queries = spark.createDataFrame([("q", "temperature randomness"), ("p", "pears")], "query_id string, text string")
    shape = lambda df: sorted((r.query_id, r.path, r.chunk_number, r.line_no, r.content) for r in df.collect())
    for file in ("path", "metadata"):
        wanted = shape(jobs.query(table, queries, EMBEDDER, "file", k=2, file=file))
        monkeypatch.setattr(R.nn, "few_results", lambda queries, k: False)
        for bound in (65_536, 1):
            monkeypatch.setattr(R, "LINES_PER_STRETCH", bound)
            assert shape(jobs.query(table, queries, EMBEDDER, "file", k=2, file=file)) == wanted
        monkeypatch.undo()


@pytest.mark.parametrize("tail", ["", "\n", "\r\n"])
def test_files_by_rows_as_by_value(spark, tmp_path, tail):
    line = "A sentence here. Another one! And a third, it goes on? " * 3
    prose = "\n".join(line[: 7 * i % 160] + ("\r" if i % 5 == 0 else "") for i in range(2500))
    code = "\n".join(("fn f%d() {" % i if i % 9 == 0 else "    body(%d); // é" % i) for i in range(4000))
    (tmp_path / "prose.txt").write_bytes((prose + tail).encode())
    (tmp_path / "marked.txt").write_bytes(b"\xef\xbb\xbf" + (prose[:9000] + tail).encode())
    (tmp_path / "exact.txt").write_bytes(("x" * 500 + tail).encode())
    (tmp_path / "code.rs").write_bytes((code + tail).encode())
    (tmp_path / "none.txt").write_bytes(b"")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        found = {}
        for bound in (1 << 30, 0):
            chunks = jobs.chunk_folder(spark, str(tmp_path), 500, 50, whole_bytes=bound)
            found[bound] = sorted((r.metadata, r.chunk_number, r.chunk) for r in chunks.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(found[0]) > 600 and found[0] == found[1 << 30]


def test_a_log_larger_than_one_split(spark, tmp_path):
    lines = [f"{'Lineage' if i % 7 == 0 else 'ERROR' if i % 50 == 3 else 'info'} {i}" for i in range(4000)]
    (tmp_path / "big.log").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        read = S.read_lines(spark, str(tmp_path))
        assert read.select("block").distinct().count() > 5
        kept = drop_noise(read, "path", ["block", "row"], F.col("block")).orderBy("n").collect()
        chunks = jobs.chunk_folder(spark, str(tmp_path), 500, 50).orderBy("chunk_number").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    wanted = [x for x in lines if "Lineage" not in x]
    assert [(r.n, r.line) for r in kept] == list(enumerate(wanted))
    assert [r.chunk_number for r in chunks] == list(range(len(chunks)))
    whole = spark.createDataFrame([("big", "log", "\n".join(lines))], "path string, language string, text string")
    inside = chunk_files(whole, ["path"], 500, 50).orderBy("chunk_number").collect()
    assert [r.chunk for r in chunks] == [r.chunk for r in inside]


def test_one_file_or_no_logs(spark, folder, tmp_path_factory):
    target = scratch_path(spark, "one")
    one = jobs.load(spark, str(folder / "notes.txt"), target, EMBEDDER, partitions=2)
    assert sorted(r.content for r in one.collect()) == [
        "Mirostat controls perplexity.", "Temperature controls randomness.",
    ]
    log = jobs.load(spark, str(folder / "run.log"), scratch_path(spark, "log"), EMBEDDER, partitions=2)
    assert log.count() == 24
    plain = tmp_path_factory.mktemp("plain")
    (plain / "a.py").write_text("def f():\n    pass\n")
    assert jobs.load(spark, str(plain), scratch_path(spark, "py"), EMBEDDER, partitions=2).count() == 2


def test_workers_need_no_path(tmp_path):
    """The package reaches the Python workers from any working directory."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        f"import sys; sys.path.insert(0, {root!r})\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "import __spark_entry__ as entry\n"
        "assert entry.entry(spark).count() == 300\n"
    )
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", code], cwd=tmp_path, env=environment, capture_output=True, timeout=300
    )
    assert done.returncode == 0, done.stderr.decode()[-2000:]
