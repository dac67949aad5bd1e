from pyspark.sql import functions as F

from lodestone.operators import lines as L


def context(text, around=20):
    """The rules written out plainly."""
    kept = [x for x in text.split("\n") if "lineage" not in x.lower()]
    found = []
    for i, line in enumerate(kept):
        if "error" in line.lower() or "exception" in line.lower():
            for j in range(max(0, i - around), min(len(kept), i + around + 1)):
                if kept[j].strip():
                    found.append((i, j, kept[j]))
    return found


def log_text(n, hits, lineage=(), blank=()):
    rows = []
    for i in range(n):
        word = "ERROR" if i in hits else "Lineage" if i in lineage else "info"
        rows.append("  " if i in blank else f"{word} {i}")
    return "\n".join(rows)


LOGS = {
    "close": log_text(40, {10, 25}),
    "noise": log_text(60, {30}, lineage=set(range(20, 30)) | {31, 33}, blank={12, 35}),
    "none": log_text(30, set()),
    "long": log_text(500, {0, 3, 250, 498}, lineage=set(range(100, 180)), blank={251}),
    "short": "Exception",
}


def frame(spark):
    return spark.createDataFrame(list(LOGS.items()), "path string, text string")


def numbered(spark):
    lines = L.explode_lines(frame(spark), "text", ["path"])
    return L.drop_noise(lines, "path", slice_by=F.floor(F.col("line_no") / 32))


def test_noise_is_dropped_before_numbering(spark):
    found = numbered(spark).where("path = 'noise'").orderBy("n").collect()
    kept = [x for x in LOGS["noise"].split("\n") if "Lineage" not in x]
    assert [(r.n, r.line) for r in found] == list(enumerate(kept))


def test_context_repeats_shared_lines(spark):
    found = L.error_context(numbered(spark), "path").collect()
    for path, text in LOGS.items():
        got = sorted((r.hit_n, r.n, r.line) for r in found if r.path == path)
        assert got == context(text)


def test_context_once(spark):
    found = L.error_context(numbered(spark), "path", dedupe=True).collect()
    for path, text in LOGS.items():
        got = sorted((r.n, r.line) for r in found if r.path == path)
        assert got == sorted({(j, line) for _, j, line in context(text)})


def test_context_inside_one_row_agrees(spark):
    found = frame(spark).select("path", L.error_text(F.col("text")).alias("lines")).collect()
    for row in found:
        assert row.lines == [line for _, _, line in context(LOGS[row.path])]


def test_lines_join_back(spark):
    lines = L.explode_lines(frame(spark), "text", ["path"])
    for slice_by in (None, F.floor(F.col("line_no") / 7)):
        found = L.join_lines(lines, "path", slice_by=slice_by).collect()
        assert {r.path: r.text for r in found} == LOGS
