from pyspark.sql import functions as F

from lodestone.functions import text as X


def values(spark, texts, make):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in rows.select("i", make(F.col("t")).alias("v")).orderBy("i").collect()]


def test_lines(spark):
    texts = ["a\r\nb\n\nc", "a\n", "", "\n", "a\r", "a\r\n", "x\n\n", None]
    assert values(spark, texts, X.split_lines) == [
        ["a", "b", "", "c"], ["a"], [], [""], ["a\r"], ["a"], ["x", ""], None,
    ]


def test_blank_and_trim(spark):
    texts = ["", " \t", "\u00a0\u2003", " a\u00a0"]
    assert values(spark, texts, X.is_blank) == [True, True, True, False]
    assert values(spark, texts, X.trim_space) == ["", "", "", "a"]


def test_every_space_is_trimmed(spark):
    spaces = [c for c in map(chr, range(0x10000)) if not 0xD800 <= ord(c) < 0xE000 and (c.isspace() and not "\x1c" <= c <= "\x1f")]
    assert sorted(spaces) == sorted(X.SPACES)
    pattern = lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", "")
    texts = [c + "a b" + c + c for c in map(chr, [*range(1, 0x300), *range(0x1600, 0x3100), 0xFEFF])] + ["\r\n a \n\n", X.SPACES]
    assert values(spark, texts, X.trim_space) == values(spark, texts, pattern)
    assert "regexp_replace" not in str(X.trim_space(F.col("t")))


def test_paths(spark):
    paths = ["/x/a.rs", "b.RS", "c.h", "d.png", "e", "x/mod.rs", ".gitignore", "/x/", "t.tar.log"]
    assert values(spark, paths, X.language_of) == [
        "rust", None, "c", None, None, "rust", None, None, "log",
    ]
    assert values(spark, paths, X.base_name) == [
        "a.rs", "b.RS", "c.h", "d.png", "e", "mod.rs", ".gitignore", "None", "t.tar.log",
    ]


def test_numbers_from_text(spark):
    texts = ["5", "x", "3", " 4", "+7", "-2", "99999999999", "", None, "1.5"]
    assert values(spark, texts, X.parsed_int) == [5, 0, 3, 0, 7, -2, 0, 0, 0, 0]


def test_marked_and_contains(spark):
    assert values(spark, ["a", None], X.marked) == ["a", "NULL"]
    found = values(spark, ["Some ERROR", "fine", "exCeption"], lambda c: X.contains_any(c, ["error", "exception"]))
    assert found == [True, False, True]
