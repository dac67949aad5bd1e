"""Column functions on text and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.schema import LANGUAGES


#: Every Unicode white space.
SPACES = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def split_lines(text: Column) -> Column:
    """Lines of a text: cut at LF or CRLF, no empty line after a final newline.

    Only a text with a carriage return is cut by a pattern, which takes several
    times as long as a single character.
    """
    ended = F.when(text.endswith("\n"), F.regexp_replace(text, r"\r?\n\z", "")).otherwise(text)
    lines = F.when(text.contains("\r"), F.split(ended, r"\r?\n", -1)).otherwise(F.split(ended, "\n", -1))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(lines)


def trim_space(text: Column) -> Column:
    """Trim every Unicode white space, not only blanks."""
    return F.btrim(text, F.lit(SPACES))


def is_blank(text: Column) -> Column:
    return ~text.rlike(r"(?U)\S")


def contains_any(text: Column, words) -> Column:
    """Whether any of the words occurs, in any case."""
    lowered = F.lower(text)
    found = F.lit(False)
    for word in words:
        found = found | lowered.contains(word.lower())
    return found


def base_name(path: Column) -> Column:
    """Last part of a path; ``"None"`` when there is none."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.coalesce(F.when(name != "", name), F.lit("None"))


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)


def language_of(path: Column) -> Column:
    """Language by file extension (case-sensitive), null for files not loaded."""
    entries = [F.lit(item) for pair in LANGUAGES.items() for item in pair]
    return F.element_at(F.create_map(*entries), extension(path))


def marked(column: Column) -> Column:
    """A column as text, nulls as the word NULL."""
    return F.coalesce(column.cast("string"), F.lit("NULL"))


def parsed_int(text: Column) -> Column:
    """A whole number read from text, 0 when it is none.

    Text that cannot be a number is told apart first: a failing cast is slow.
    """
    number = F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("int"))
    return F.coalesce(number, F.lit(0))
