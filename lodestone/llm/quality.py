"""Quality rules as a cascade, ordered by what a rule rejects for what it costs.

The figures of a text are column expressions. On a sample of the rows every rule
is timed and its rejections are counted; the cascade then tries the rule with
the most rejections per second first and stops at the first that rejects. The
order changes the cost, never the verdict.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.tables import stored

#: Word separators: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: About so many rows serve to estimate costs and rejections; the verdicts cover all rows.
SAMPLE_ROWS = 2000


def words(text: Column) -> Column:
    """The words of a text; none for a null, empty or blank one."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, "[\\x20\\x09-\\x0D]+")
    )


def worded_lines(text: Column) -> Column:
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.filter(lines, lambda line: F.btrim(line, F.lit(SPACE)) != "")


def figures(docs: DataFrame) -> DataFrame:
    """``doc_id, text, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words``.

    Null texts count as empty; all figures are then 0. Windows are compared by
    a 64-bit hash within their own text. Every step is linear in the text but
    for the sort of the windows of a text that repeats one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    step = docs.select("doc_id", "text", words(F.col("text")).alias("w"), worded_lines(F.col("text")).alias("l"))
    hashes = F.when(
        F.size("w") >= WINDOW,
        F.transform(
            F.sequence(F.lit(1), F.size("w") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("w", i, WINDOW))
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    step = step.select(
        "doc_id",
        "text",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        hashes.alias("h"),
    )
    # most texts repeat no window and end here; the others sort theirs and look at neighbours
    placed = F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    step = step.withColumn("placed", F.when(F.size(F.array_distinct("h")) < F.size("h"), placed))

    def same(x: Column, at: Column) -> Column:
        return F.coalesce(x["h"] == F.get(F.col("placed"), at)["h"], F.lit(False))

    again = F.filter("placed", lambda x, i: same(x, i - 1) | same(x, i + 1))
    starts = F.sort_array(F.transform(again, lambda x: x["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, i: F.struct(
            (a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n"), (i + WINDOW).alias("end")
        ),
        lambda a: a["n"].cast("long"),
    )
    return step.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("h", "placed")


@dataclass(frozen=True)
class Rule:
    """A text fails where ``fails`` holds, an expression over the columns of ``figures``."""

    name: str
    fails: str


def base_failed() -> Column:
    return F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words")


#: Beside the base: mild rules that ordinary prose of any language passes.
RULES = (
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    Rule("symbols", "5 * n_symbols > word_chars"),
    Rule("dup_lines", "2 * n_dup_lines > n_lines"),
    Rule("letters", "2 * length(regexp_replace(text, '[^\\\\p{L}]', '')) < word_chars"),
)


def cascade_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS) -> list[Rule]:
    """``rules`` by rejections per second on about ``rows`` rows, the best first.

    Rows are drawn before their figures are computed.
    """
    total = docs.count()
    share = min(1.0, rows / total) if total else 1.0
    sample = stored(figures(docs.sample(share, 7)), "rules")

    def seconds(fails: str) -> tuple[float, int]:
        began = time.perf_counter()
        found = sample.agg(F.count_if(F.expr(fails)).alias("n")).first().n
        return time.perf_counter() - began, found

    seconds("false")
    idle = seconds("false")[0]
    worth = {}
    for rule in rules:
        took, rejected = seconds(rule.fails)
        worth[rule.name] = rejected / max(took - idle, 1e-3)
    return sorted(rules, key=lambda rule: -worth[rule.name])


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``figures`` of every row with ``base_failed``, ``kept`` and ``failed_rule``.

    ``failed_rule`` is the first rule of the cascade that rejects, null where the
    row is kept; which of several it names depends on the measured order.
    Rows are not moved, so a hot source or repeated rows change nothing.
    """
    measured = figures(docs)
    order = cascade_order(docs.select("doc_id", "text"), rules)
    verdict = F.when(base_failed(), "base")
    for rule in order:
        verdict = verdict.when(F.expr(rule.fails), rule.name)
    found = measured.withColumn("base_failed", base_failed()).withColumn("failed_rule", verdict)
    return found.withColumn("kept", F.col("failed_rule").isNull())
