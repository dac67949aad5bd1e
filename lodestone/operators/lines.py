"""Lines of texts, log context around errors, and lines back to texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import contains_any, is_blank, split_lines
from lodestone.operators.ordering import numbered
from lodestone.schema import ERROR_WORDS, LOG_CONTEXT, NOISE_WORDS

# Lines of one file that one task sorts or joins at a time.
LINES_PER_SLICE = 8192


def explode_lines(df: DataFrame, text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """One row per line: the kept columns, ``line_no`` from 0 and ``line``."""
    return df.select(*keep, F.posexplode(split_lines(F.col(text))).alias("line_no", "line"))


def drop_noise(
    lines: DataFrame,
    file: str,
    order: str | Sequence[str] = "line_no",
    slice_by: Column | None = None,
    words: Sequence[str] = NOISE_WORDS,
    marks: Sequence[str] = ERROR_WORDS,
) -> DataFrame:
    """Lines without the noise words, renumbered from 0 per file as ``n``.

    ``slice_by`` splits a long file; it defaults to stretches of ``order``,
    which then has to be a line number. ``hit`` tells whether a line holds one
    of ``marks``: known before lines are shuffled, it lets ``error_context``
    look for hits without moving their text.
    """
    order = [order] if isinstance(order, str) else list(order)
    if slice_by is None:
        slice_by = F.floor(F.col(order[0]) / LINES_PER_SLICE)
    kept = lines.where(~contains_any(F.col("line"), words)).withColumn(
        "hit", contains_any(F.col("line"), marks)
    )
    return numbered(kept, [file], order, slice_by, "n")


def error_context(
    lines: DataFrame,
    file: str,
    around: int = LOG_CONTEXT,
    dedupe: bool = False,
    skip_blank: bool = True,
) -> DataFrame:
    """Lines within ``around`` lines of a line marked as ``hit``.

    ``lines`` has ``n`` dense per file (see ``drop_noise``). Each hit names the line numbers it
    wants, and those meet the lines by plain equality on ``(file, n)``: keys
    are unique on the line side, so a huge file spreads over all tasks.

    Context lines shared by close hits appear once per hit, with the number
    of the hit in ``hit_n``; ``dedupe`` gives each line once.
    """
    reach = F.sequence(F.col("n") - around, F.col("n") + around)
    wanted = (
        lines.where("hit")
        .select(F.col(file), F.col("n").alias("hit_n"), F.explode(reach).alias("n"))
        .where(F.col("n") >= 0)
    )
    if skip_blank:
        lines = lines.where(~is_blank(F.col("line")))
    if dedupe:
        return lines.join(wanted.select(file, "n").distinct(), [file, "n"], "left_semi")
    return lines.join(wanted, [file, "n"])


def drop_blank(lines: DataFrame, line: str = "line") -> DataFrame:
    return lines.where(~is_blank(F.col(line)))


def join_lines(
    lines: DataFrame,
    file: str,
    order: Sequence[str] = ("line_no",),
    slice_by: Column | None = None,
    line: str = "line",
    name: str = "text",
) -> DataFrame:
    """One text per file, its lines joined with newlines in order.

    Stretches of a file are joined first, each in a task of its own; only the
    finished pieces, as long as the result itself, come together per file.
    """
    order = list(order)
    if slice_by is None:
        slice_by = F.floor(F.col(order[0]) / LINES_PER_SLICE)

    def joined(of, keys):
        ordered = F.sort_array(F.collect_list(F.struct(*keys, of)))
        return F.array_join(F.transform(ordered, lambda item: item[of]), "\n")

    pieces = (
        lines.where(F.col(line).isNotNull())
        .withColumn("_slice", slice_by)
        .groupBy(file, "_slice")
        .agg(joined(line, order).alias("_piece"))
    )
    return pieces.groupBy(file).agg(joined("_piece", ["_slice"]).alias(name))


def error_text(
    text: Column,
    around: int = LOG_CONTEXT,
    noise: Sequence[str] = NOISE_WORDS,
    words: Sequence[str] = ERROR_WORDS,
) -> Column:
    """The log context of one whole file held in a column, as one array of lines.

    Needs no shuffle: the same rules as ``drop_noise`` followed by
    ``error_context``, for files read as single values.
    """
    return F.filter(
        _context_of(F.filter(split_lines(text), lambda x: ~contains_any(x, noise)), around, words),
        lambda x: ~is_blank(x),
    )


def _context_of(lines: Column, around: int, words: Sequence[str]) -> Column:
    held = F.array(F.struct(lines.alias("lines")))

    def around_hits(item):
        kept = item["lines"]
        marks = F.transform(kept, lambda x, i: F.when(contains_any(x, words), i))
        hits = F.filter(marks, lambda i: i.isNotNull())
        first = lambda i: F.greatest(i - around, F.lit(0))
        return F.flatten(
            F.transform(
                hits, lambda i: F.slice(kept, first(i) + 1, i + around + 1 - first(i))
            )
        )

    return F.flatten(F.transform(held, around_hits))
