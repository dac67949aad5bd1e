import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.operators import chunks as C
from lodestone.operators import lines as L
from lodestone.operators import packing


def units_of(text, cap, boundary=None):
    """The unit rules written out plainly."""
    units = [u for u in re.split(boundary, text) if u] if boundary else [text]
    for pattern in (C.LINE, C.SENTENCE.replace(r"\z", r"\Z"), C.WORD):
        units = [
            p
            for u in units
            for p in ([m.group(0) for m in re.finditer(pattern, u)] if len(u) > cap else [u])
        ]
    return [u[i : i + cap] for u in units for i in range(0, max(len(u), 1), cap)]


def packed(units, cap, overlap):
    chunks, first, i = [], 0, 0
    size = 0
    while i < len(units):
        if size + len(units[i]) <= cap:
            size += len(units[i])
            i += 1
            continue
        chunks.append((first, i))
        start = i
        for j in range(first + 1, i + 1):
            kept = sum(len(u) for u in units[j:i])
            if kept <= overlap and kept + len(units[i]) <= cap:
                start = j
                break
        first, size = start, sum(len(u) for u in units[start:i])
    chunks.append((first, len(units)))
    return chunks


def wanted(text, cap, overlap, boundary=None):
    units = units_of(text, cap, boundary)
    joined = ["".join(units[a:b]).strip() for a, b in packed(units, cap, overlap)] if units else []
    return [c for c in joined if c]


def chunks(spark, texts, cap, overlap, boundary=None):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    found = C.chunk_text(df, "text", ["i"], cap, overlap, boundary).orderBy("i", "chunk_number")
    by_text = {i: [] for i in range(len(texts))}
    for row in found.collect():
        assert row.chunk_number == len(by_text[row.i])
        by_text[row.i].append(row.chunk)
    return [by_text[i] for i in range(len(texts))]


TEXTS = [
    "",
    "\n",
    "short",
    "one line\nanother line\n\nlast",
    "x" * 5000,
    "word " * 300,
    "A sentence here. Another one! And a third? " * 40,
    "\n".join(f"line {i} " + "y" * (i % 60) for i in range(200)),
    "é" * 130 + "\n" + "ß ü " * 100,
    "  \n \n  ",
]


@pytest.mark.parametrize("cap,overlap", [(100, 20), (64, 63), (50, 0), (2048, 256), (1, 0)])
def test_chunks_follow_the_rules(spark, cap, overlap):
    assert chunks(spark, TEXTS, cap, overlap) == [wanted(t, cap, overlap) for t in TEXTS]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab .!?\n", max_size=300), min_size=1, max_size=20))
def test_chunk_contract(spark, texts):
    cap, overlap = 40, 12
    for text, found in zip(texts, chunks(spark, texts, cap, overlap)):
        assert all(0 < len(c) <= cap and c == c.strip() for c in found)
        assert "".join(text.split()) == "" or found
        assert found == wanted(text, cap, overlap)


def test_overlap_must_be_smaller(spark):
    df = spark.createDataFrame([(1, "a")], "i int, text string")
    for make in (C.chunk_text, C.chunk_fixed):
        with pytest.raises(ValueError):
            make(df, "text", ["i"], 256, 256)


CODE = "use a;\n\nfn one() {\n    body();\n}\n\npub fn two() {\n    body();\n}\nstruct S;\n"


def test_code_breaks_at_declarations(spark):
    df = spark.createDataFrame([("rust", CODE), ("text", CODE)], "language string, text string")
    found = C.chunk_code(df, keep=["language"], cap=33, overlap=0).orderBy("chunk_number").collect()
    rust = [r.chunk for r in found if r.language == "rust"]
    assert rust == ["use a;", "fn one() {\n    body();\n}", "pub fn two() {\n    body();\n}", "struct S;"]
    assert [r.chunk for r in found if r.language == "text"] == wanted(CODE, 33, 0)


@pytest.mark.parametrize(
    "language,text,starts",
    [
        ("python", "import x\ndef f():\n  pass\n@d\nclass A:\n  def g(self): pass\n", ["import", "def f", "@d", "class A"]),
        ("go", "package m\nfunc A() {}\ntype T struct{}\n", ["package", "func", "type"]),
        ("java", "package a;\npublic class A {\n  private int x;\n}\n", ["package", "public", "  private"]),
        ("scala", "import a\nobject A {\n  def f = 1\n}\n", ["import", "object", "  def"]),
        ("javascript", "'use';\nfunction a() {}\nconst b = 1;\n", ["'use'", "function", "const"]),
        ("typescript", "'use';\nexport interface A {}\n", ["'use'", "export"]),
        ("c", "#include <a>\nint main(void) {\n  return 0;\n}\n", ["#include", "int main"]),
        ("cpp", "#include <a>\nnamespace n {\nint f(int a) {\n}\n}\n", ["#include", "namespace", "int f"]),
    ],
)
def test_declarations_by_language(spark, language, text, starts):
    df = spark.createDataFrame([(text,)], "text string")
    units = F.split("text", F.lit(C.DECLARATIONS[language]), -1)
    found = [u for u in df.select(units.alias("u")).first().u if u]
    assert [u.startswith(s) for u, s in zip(found, starts)] == [True] * len(starts)
    assert len(found) == len(starts) and "".join(found) == text


def test_files_by_kind(spark):
    log = "\n".join(["ok"] * 30 + ["an error"] + ["ok"] * 30)
    files = spark.createDataFrame(
        [("a", "text", "one\ntwo"), ("b", "log", log), ("c", "log", "fine"), ("d", "rust", CODE)],
        "path string, language string, text string",
    )
    found = C.chunk_files(files, ["path"], 33, 0).orderBy("path", "chunk_number").collect()
    by_path = {}
    for row in found:
        by_path.setdefault(row.path, []).append(row.chunk)
    assert by_path["a"] == ["one\ntwo"] and "c" not in by_path
    assert "\n".join(by_path["b"]).split("\n") == ["ok"] * 20 + ["an error"] + ["ok"] * 20
    assert by_path["d"][1].startswith("fn one")


def test_fixed_windows(spark):
    texts = ["", "a" * 10, "abcdefghij" * 7]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    found = C.chunk_fixed(df, "text", ["i"], 20, 5).orderBy("i", "chunk_number").collect()
    assert [r.chunk for r in found if r.i == 1] == ["a" * 10]
    assert [r.chunk for r in found if r.i == 2] == [texts[2][s : s + 20] for s in (0, 15, 30, 45, 60)]


def test_global_numbers(spark):
    rows = [(f"f{f}", c) for f in range(50) for c in range(f % 5 + 1)]
    df = spark.createDataFrame(rows, "path string, chunk_number int")
    found = C.number_chunks(df, "path").collect()
    assert sorted(r.id for r in found) == list(range(len(rows)))
    for path in {r[0] for r in rows}:
        ids = [r.id for r in sorted(found, key=lambda r: r.chunk_number) if r.path == path]
        assert ids == list(range(ids[0], ids[0] + len(ids)))
    ordered = C.number_chunks(df, "path", F.lit(0)).orderBy("id").collect()
    assert [(r.path, r.chunk_number) for r in ordered] == sorted(rows)


def shape(df):
    return sorted((r.path, r.chunk_number, r.chunk) for r in df.collect())


def test_logs_by_rows(spark):
    log = "\n".join("an error" if i % 9 == 0 else f"line {i}" for i in range(400))
    lines = L.explode_lines(spark.createDataFrame([("a", log), ("b", "error")], "path string, text string"), "text", ["path"])
    context = L.error_context(L.drop_noise(lines, "path"), "path")
    whole = spark.createDataFrame([("a", "log", log), ("b", "log", "error")], "path string, language string, text string")
    wanted = shape(C.chunk_files(whole, ["path"], 100, 20))
    assert shape(C.chunk_log(context, "path", [], 100, 20)) == wanted
    assert shape(C.chunk_log(context, "path", [], 100, 20, slice_chars=1)) == wanted


def test_long_logs_by_rows(spark):
    """Beyond line 4,096, in many slices and in groups of slices."""
    log = "\n".join(("an error " if i % 5 == 0 else "line ") + "x" * (i * i % 83) + f" {i}" for i in range(9000))
    whole = spark.createDataFrame([("a", "log", log)], "path string, language string, text string")
    lines = L.explode_lines(whole, "text", ["path"])
    context = L.error_context(L.drop_noise(lines, "path"), "path")
    by_value = shape(C.chunk_files(whole, ["path"]))
    assert len(by_value) > 500
    assert shape(C.chunk_log(context, "path", [])) == by_value
    assert shape(C.chunk_log(context, "path", [], slice_chars=1)) == by_value


def rows_of(spark, texts, languages=None):
    rows = [
        (name, None if languages is None else languages[k], n, line)
        for k, (name, text) in enumerate(texts)
        for n, line in enumerate(re.findall(C.LINE, text))
    ]
    return spark.createDataFrame(rows, "path string, language string, n int, line string")


@pytest.mark.parametrize("cap,overlap", [(40, 12), (64, 63), (50, 0), (7, 3)])
def test_texts_by_rows(spark, cap, overlap, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 3)
    rng = random.Random(cap)
    letters = "ab c.\n\n!? é"
    texts = [("t%02d" % k, "".join(rng.choice(letters) for _ in range(rng.choice([0, 5, 300, 4000])))) for k in range(12)]
    texts += [("w%02d" % k, t * 3) for k, t in enumerate(TEXTS)]
    rows = rows_of(spark, texts)
    found = shape(C.chunk_rows(rows, "path", ["n"], F.floor(F.col("n") / 50), [], cap, overlap, slice_chars=1))
    assert found == [(name, n, c) for name, t in sorted(texts) for n, c in enumerate(wanted(t, cap, overlap))]


SOURCES = {
    "rust": "use a;\n\nfn one() {\n    body();\n}\n\npub fn two() {\n    body();\n}\nstruct S;\n",
    "python": "import x\ndef f():\n  pass\n@d\nclass A:\n  def g(self): pass\n",
    "c": "#include <a>\nint main(void)\n{\n  return f(1);\n}\nstatic int x;\r\nint g(int a,\n int b) {\n}\n",
    "go": "package m\nfunc A() {}\rfunc B() {}\ntype T struct{}\n" + "// " + "word " * 60 + "\n",
}


@pytest.mark.parametrize("cap,overlap", [(45, 9), (80, 40), (200, 20)])
def test_code_by_rows(spark, cap, overlap, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 4)
    rng = random.Random(cap)
    texts, languages = [], []
    for k in range(16):
        language = list(SOURCES)[k % 4]
        lines = re.findall(C.LINE, SOURCES[language])
        # stretches without any declaration are longer than a chunk, blocks often shorter
        picked = [rng.choice(lines) if rng.random() < 0.7 else "  plain text here\n" * rng.randrange(6) for _ in range(150)]
        texts.append(("f%02d" % k, "".join(picked)))
        languages.append(language)
    whole = spark.createDataFrame(
        [(name, language, text) for (name, text), language in zip(texts, languages)], "path string, language string, text string"
    )
    boundary = C.declaration_start(F.col("language"))
    rows = rows_of(spark, texts, languages)
    found = C.chunk_rows(rows, "path", ["n"], F.floor(F.col("n") / 50), [], cap, overlap, boundary, slice_chars=1)
    assert shape(found) == shape(C.chunk_code(whole, keep=["path"], cap=cap, overlap=overlap))


def test_rows_without_a_file(spark):
    rows = rows_of(spark, [])
    assert C.chunk_rows(rows, "path", ["n"], F.lit(0)).count() == 0
    one = spark.createDataFrame([(None, 0, "a line\n")], "path string, n int, line string")
    assert [tuple(r) for r in C.chunk_rows(one, "path", ["n"], F.lit(0)).collect()] == [(None, 0, "a line")]


def test_rows_are_made_once_and_short_files_need_no_ways(spark, monkeypatch):
    texts = [(f"f{k}", f"{k} " + "some words. " * (k % 7) + "\nanother line\n") for k in range(20)]
    rows, kept = rows_of(spark, texts), {}
    store = C.stored

    def noted(df, name):
        kept.setdefault(name, []).append(store(df, name))
        return kept[name][-1]

    monkeypatch.setattr(C, "stored", noted)
    monkeypatch.setattr(packing, "stored", noted)
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(line):
        read.add(1)
        return line

    lines = rows.withColumn("line", counted.asNondeterministic()("line"))
    found = C.chunk_rows(lines, "path", ["n"], F.lit(0), [], 40, 10)
    assert found.count() > 20
    assert read.value == rows.count()
    assert kept["chunk-ways"][0].isEmpty() and kept["chunk-files"][0].count() == 20
