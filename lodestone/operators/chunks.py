"""Overlapping chunks of whole texts, as column expressions.

A text is cut into units that tile it exactly, and neighbouring units are
packed into chunks of at most ``cap`` characters. Each chunk repeats up to
``overlap`` characters of the one before and loses its outer white space.
This keeps the contract of a semantic splitter (size, overlap, coarsest break
that fits), not the bytes of any particular one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.text import is_blank, trim_space
from lodestone.operators.joins import join_same
from lodestone.operators.lines import error_text
from lodestone.operators.ordering import running_offsets, running_total
from lodestone.operators.packing import pack_pieces
from lodestone.schema import CHUNK_OVERLAP, CHUNK_SIZE
from lodestone.session import has_at_most, stored

LINE = r"[^\n]*\n|[^\n]+"
SENTENCE = r"(?s).+?(?:[.!?]+[ \t\r\n]+|\z)"
WORD = r"[^ \t\r\n]+[ \t\r\n]*|[ \t\r\n]+"

# Line numbers of hits whose context one task sorts at a time.
HITS_PER_SORT = 4096

# Starts of parts of files that are few enough to send to every task.
SENT_STARTS = 200_000

# Where a declaration starts, by language: the text is cut before each match.
DECLARATIONS = {
    "rust": r"(?m)(?=^(?:pub(?:\([a-z]+\))? |async |unsafe )*(?:fn|struct|enum|trait|impl|mod|const|static|type|macro_rules!)\b)",
    "python": r"(?m)(?=^(?:@|class |def |async def ))",
    "java": r"(?m)(?=^[ \t]*(?:@\w+|(?:public|protected|private|static|final|abstract) ))",
    "javascript": r"(?m)(?=^(?:export |async |default )*(?:function|class|const|let|var)\b)",
    "typescript": r"(?m)(?=^(?:export |async |default |declare |abstract )*(?:function|class|interface|type|enum|namespace|const|let|var)\b)",
    "tsx": r"(?m)(?=^(?:export |async |default |declare |abstract )*(?:function|class|interface|type|enum|namespace|const|let|var)\b)",
    "go": r"(?m)(?=^(?:func|type|var|const)\b)",
    "scala": r"(?m)(?=^[ \t]*(?:(?:case|abstract|sealed|implicit|override|private|protected|final|lazy) )*(?:class|object|trait|def|val|type)\b)",
    "c": r"(?m)(?=^(?:[A-Za-z_][\w \t*]*\([^;]*$|(?:struct|enum|union|typedef|static|extern)\b))",
    "cpp": r"(?m)(?=^(?:[A-Za-z_][\w \t*&:<>,]*\([^;]*$|(?:template|class|struct|enum|union|namespace|typedef|using|static|extern)\b))",
}


def _check(cap: int, overlap: int) -> None:
    if cap < 1 or overlap < 0 or overlap >= cap:
        raise ValueError("overlap must be smaller than the chunk size")


def _cut(unit: Column, cap: int, levels) -> Column:
    """The unit if it fits, else its parts, cut further by the next levels."""
    if not levels:
        return F.array(unit)
    parts = F.transform(levels[0](unit), lambda part: _cut(part, cap, levels[1:]))
    return F.when(F.length(unit) <= cap, F.array(unit)).otherwise(F.flatten(parts))


def _tiles(pattern: str):
    return lambda text: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _pieces(cap: int):
    def cut(text):
        starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(cap))
        return F.transform(starts, lambda s: F.substring(text, s, F.lit(cap)))

    return cut


def text_units(text: Column, cap: int, boundary: Column | str | None = None) -> Column:
    """Units that tile ``text``, none longer than ``cap``.

    The whole text if it fits, else its lines; a longer line falls into
    sentences, a longer sentence into words and a longer word into pieces.
    ``boundary`` (a regular expression that matches the empty string before
    each declaration) puts whole declarations above lines; where it is null
    there are none.
    """
    units = F.array(text)
    if boundary is not None:
        pattern = F.lit(boundary) if isinstance(boundary, str) else boundary
        blocks = F.filter(F.split(text, pattern, -1), lambda u: u != "")
        units = F.when(pattern.isNotNull(), blocks).otherwise(units)
    return _within(units, cap)


def line_units(lines: Column, cap: int) -> Column:
    """Units of a text given as an array of lines, which is never joined whole."""
    return _within(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), cap)


def _within(units: Column, cap: int) -> Column:
    levels = (_tiles(LINE), _tiles(SENTENCE), _tiles(WORD), _pieces(cap))
    return F.flatten(F.transform(units, lambda unit: _cut(unit, cap, levels)))


def pack(lengths: Column, cap: int, overlap: int) -> Column:
    """Spans ``(first, past)`` of unit positions, one per chunk.

    One pass over the units. When the next unit would not fit, the chunk ends
    and the next one starts at the earliest unit that keeps both the repeated
    part within ``overlap`` and the repeat plus the new unit within ``cap``.
    """
    span = "array<struct<first:int,past:int>>"
    nothing = F.array().cast(span)

    def state(first, size, spans):
        return F.struct(
            first.cast("int").alias("first"), size.cast("int").alias("size"), spans.alias("spans")
        )

    def closed(first, past):
        return F.array(F.struct(first.cast("int").alias("first"), past.cast("int").alias("past")))

    def step(acc, unit):
        position, length = unit["position"], unit["length"]

        def back(kept, earlier):
            grown = kept["size"] + F.get(lengths, earlier)
            fits = kept["open"] & (grown <= overlap) & (grown + length <= cap)
            return F.struct(
                F.when(fits, earlier).otherwise(kept["first"]).alias("first"),
                F.when(fits, grown).otherwise(kept["size"]).alias("size"),
                fits.alias("open"),
            )

        behind = F.when(
            position - acc["first"] > 1, F.sequence(position - 1, acc["first"] + 1, F.lit(-1))
        ).otherwise(F.array().cast("array<int>"))
        empty = F.struct(
            position.alias("first"), F.lit(0).alias("size"), F.lit(True).alias("open")
        )

        def reopened(kept):
            return state(
                kept["first"],
                kept["size"] + length,
                F.concat(acc["spans"], closed(acc["first"], position)),
            )

        fits = acc["size"] + length <= cap
        grown = state(acc["first"], acc["size"] + length, acc["spans"])
        return F.when(fits, grown).otherwise(F.aggregate(behind, empty, back, reopened))

    units = F.transform(
        lengths, lambda x, i: F.struct(i.alias("position"), x.cast("int").alias("length"))
    )
    return F.aggregate(
        units,
        state(F.lit(0), F.lit(0), nothing),
        step,
        lambda acc: F.when(
            F.size(lengths) > 0,
            F.concat(acc["spans"], closed(acc["first"], F.size(lengths))),
        ).otherwise(nothing),
    )


def _chunk_units(
    df: DataFrame, units: Column, cap: int, overlap: int, keep: Sequence[str]
) -> DataFrame:
    """Pack a column of units and explode the chunks with their numbers.

    Each intermediate array is used more than once by the next projection, so
    Catalyst keeps it as a column instead of copying its expression into the
    lambdas that read it.
    """
    sized = df.select(*keep, units.alias("_units")).select(
        *keep,
        "_units",
        F.transform("_units", lambda u: F.length(u)).alias("_lengths"),
    )
    spans = sized.select(*keep, "_units", pack(F.col("_lengths"), cap, overlap).alias("_spans"))
    joined = F.transform(
        "_spans",
        lambda s: trim_space(
            F.array_join(F.slice(F.col("_units"), s["first"] + 1, s["past"] - s["first"]), "")
        ),
    )
    filled = F.when(F.size("_units") > 0, F.filter(joined, lambda c: c != ""))
    return spans.select(*keep, F.posexplode(filled).alias("chunk_number", "chunk"))


def chunk_text(
    df: DataFrame,
    text: str = "text",
    keep: Sequence[str] = (),
    cap: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    boundary: Column | str | None = None,
) -> DataFrame:
    """Chunks of each text: the kept columns, ``chunk_number`` from 0, ``chunk``."""
    _check(cap, overlap)
    return _chunk_units(df, text_units(F.col(text), cap, boundary), cap, overlap, keep)


def chunk_code(
    df: DataFrame,
    language: str = "language",
    text: str = "text",
    keep: Sequence[str] = (),
    cap: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
) -> DataFrame:
    """Chunks of source code that prefer to break where a declaration starts.

    Languages without declarations, such as plain text, break at lines.
    """
    return chunk_text(df, text, keep, cap, overlap, declaration_start(F.col(language)))


def declaration_start(language: Column) -> Column:
    """The pattern of a language's declarations, null when it has none."""
    entries = [F.lit(item) for pair in DECLARATIONS.items() for item in pair]
    return F.element_at(F.create_map(*entries), language)


def chunk_lines(
    df: DataFrame,
    lines: Column,
    keep: Sequence[str] = (),
    cap: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
) -> DataFrame:
    """Chunks of texts given as arrays of lines."""
    _check(cap, overlap)
    return _chunk_units(df, line_units(lines, cap), cap, overlap, keep)


def chunk_rows(
    rows: DataFrame,
    file: str,
    order: Sequence[str],
    slice_by: Column,
    keep: Sequence[str] = (),
    cap: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    boundary: Column | None = None,
    slice_chars: int | None = None,
) -> DataFrame:
    """Chunks of files given as rows ``line`` (with its line feed) in the order of ``order``.

    The chunks are those of the whole text, however long it is: no task holds
    more than a slice of it. ``slice_by`` bounds what one task sorts (see
    ``running_total``). ``boundary`` is as in ``text_units``, per row.
    """
    _check(cap, overlap)
    whole = F.array(F.col("line"))
    if boundary is None:
        blocks, opens = whole, F.lit(None).cast("boolean")
    else:
        blocks = F.when(
            boundary.isNotNull(), F.filter(F.split("line", boundary, -1), lambda u: u != "")
        ).otherwise(whole)
        # rows begin where lines do, so the first part opens a block only if a declaration is there
        opens = F.when(boundary.isNotNull(), F.regexp_like("line", F.concat(F.lit("\\A"), boundary)))
    cut = rows.select(file, *keep, *order, slice_by.alias("_part"), "line", blocks.alias("_blocks"), opens.alias("_opens"))
    parts = F.transform(
        "_blocks",
        lambda block, i: F.transform(
            _within(F.array(block), cap), lambda u, k: F.struct(u.alias("u"), i.alias("i"), k.alias("k"))
        ),
    )
    laid = cut.select(file, *keep, *order, "_part", "_opens", F.posexplode(F.flatten(parts)).alias("_at", "_unit"))
    first = F.col("_unit.k") == 0
    laid = laid.select(
        file,
        *keep,
        *order,
        "_part",
        "_at",
        F.col("_unit.u").alias("_piece"),
        F.when(F.col("_opens").isNotNull(), first & (F.col("_opens") | (F.col("_unit.i") > 0))).alias("_opens"),
    )
    # where a piece starts in its part is stored with it; where a part starts follows from what is stored,
    # so that the rows are made once
    earlier = W.partitionBy(file, "_part").orderBy(*order, "_at").rowsBetween(W.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(F.length("_piece")).over(earlier), F.lit(0)).alias("_inside")
    held = stored(
        laid.select(
            file, *keep, "_part", inside, "_piece", F.length("_piece").alias("_length"), "_opens",
            is_blank(F.col("_piece")).alias("_blank"),
        ),
        "pieces",
    )
    offsets = running_offsets(held, [file], F.col("_part"), F.col("_length")).where(F.col("_before") > 0)
    # one row for each part but a file's first; unless they are very many they are sent, so that no text is shuffled for them
    offsets = stored(offsets.withColumnRenamed("_slice", "_part"), "part-starts")
    small = has_at_most(offsets, SENT_STARTS)
    start = (F.coalesce("_before", F.lit(0)) + F.col("_inside")).cast("long")
    placed = join_same(held, offsets, [file, "_part"], small, "left").withColumn("_start", start)
    return pack_pieces(placed.drop("_part", "_inside", "_before"), file, keep, cap, overlap, slice_chars)


def chunk_log(
    context: DataFrame,
    file: str = "path",
    keep: Sequence[str] = (),
    cap: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    slice_chars: int | None = None,
) -> DataFrame:
    """Chunks of log context given as rows ``hit_n, n, line`` of any number of files.

    They are the chunks of each file's whole context, whatever its length.
    """
    rows = context.withColumn("line", F.concat("line", F.lit("\n")))
    part = F.floor(F.col("hit_n") / HITS_PER_SORT)
    return chunk_rows(rows, file, ["hit_n", "n"], part, keep, cap, overlap, slice_chars=slice_chars)


def chunk_files(
    files: DataFrame, keep: Sequence[str] = (), cap: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP
) -> DataFrame:
    """Chunks of files (``language, text``) by kind: logs by their error context,
    code by declarations, other text by lines. Every file is read once.
    """
    _check(cap, overlap)
    text, language = F.col("text"), F.col("language")
    units = F.when(language == "log", line_units(error_text(text), cap)).otherwise(
        text_units(text, cap, declaration_start(language))
    )
    return _chunk_units(files, units, cap, overlap, keep)


def chunk_fixed(
    df: DataFrame,
    text: str = "text",
    keep: Sequence[str] = (),
    cap: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
) -> DataFrame:
    """Windows of exactly ``cap`` characters (the last may be shorter), untrimmed."""
    _check(cap, overlap)
    stride = cap - overlap
    last = F.greatest(F.length(text) - overlap, F.lit(1))
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(1), last, F.lit(stride)))
    windows = F.transform(starts, lambda s: F.substring(F.col(text), s, F.lit(cap)))
    return df.select(*keep, F.posexplode(windows).alias("chunk_number", "chunk"))


def number_chunks(
    chunks: DataFrame, file: str, slice_by: Column | None = None, name: str = "id"
) -> DataFrame:
    """Adds ``name``: the 0-based ordinal of the chunk over the whole load.

    Files follow each other by ``(slice_by, file)`` and chunks by their number.
    ``slice_by`` splits the file list over tasks and never falls as the file
    rises; by default ranges of files do.
    """
    counts = chunks.groupBy(file).agg(F.count(F.lit(1)).alias("_chunks"))
    if slice_by is None:
        # one row per file, dealt by ranges once and stored with the number of its range
        counts = stored(
            counts.repartitionByRange(F.col(file).asc_nulls_first()).withColumn("_part", F.spark_partition_id()),
            "file-chunks",
        )
    else:
        counts = counts.withColumn("_part", slice_by)
    counts = counts.withColumn("_all", F.lit(0))
    starts = running_total(
        counts, ["_all"], [file], F.col("_part"), F.col("_chunks"), "_start"
    ).select(file, "_start")
    return (
        join_same(chunks, starts, [file])
        .withColumn(name, (F.col("_start") + F.col("chunk_number")).cast("long"))
        .drop("_start")
    )


def concat_chunks(frames: Sequence[DataFrame]) -> DataFrame:
    """The chunks of several frames, one after another, as one frame."""
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result
