"""Benchmark decontamination: windows of test items looked up in the windows of every text.

The distinct windows of all items are a hash set that is sent to the tasks.
Every window of a text is hashed and looked up; a hit counts when the words
themselves are equal. All steps are DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.tables import stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words of a window; an item of fewer words is one window.
WINDOW = 10
#: Characters of windows and item ids that are sent at once; a larger set is sent in several passes over the texts.
SENT_CHARS = 16 << 20
BREAK = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def lowered(text: Column) -> Column:
    """A-Z in lower case and no other letter; texts of ASCII alone take the short way."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def words(text: Column) -> Column:
    """The words of a text in lower case; none for a null text."""
    return F.array_remove(F.split(lowered(F.coalesce(text, F.lit(""))), BREAK), "")


def windows(own: Column, size: int) -> Column:
    """``at`` (from 0) and ``hash`` of every window of ``size`` words."""
    starts = F.sequence(F.lit(0), F.size(own) - size)
    hashed = F.transform(
        starts, lambda i: F.struct(i.alias("at"), F.lit(size).alias("size"), F.xxhash64(F.slice(own, i + 1, size)).alias("hash"))
    )
    return F.when(F.size(own) >= size, hashed).otherwise(F.array().cast("array<struct<at:int,size:int,hash:bigint>>"))


def item_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct windows of ``items`` (``item_id, text``): ``hash, size, window`` and the sorted ``items`` that hold it.

    An item without words has no window. The words of an item without id count
    as a window that names no item.
    """
    own = items.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(size))
    starts = F.explode(F.sequence(F.lit(1), F.size("w") - length + 1))
    cut = own.select("item_id", "w", length.alias("size"), starts.alias("i")).select(
        "item_id", "size", F.slice("w", F.col("i"), F.col("size")).alias("window")
    )
    held = cut.groupBy("size", "window").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    return held.select(F.xxhash64("window").alias("hash"), "size", "window", "items")


def _key(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def window_hits(docs: DataFrame, known: DataFrame, sent_chars: int = SENT_CHARS) -> DataFrame:
    """Per text with a hit: ``doc_id``, ``digest``, its ``hits`` (``at, size``) and ``items``.

    A set of windows above ``sent_chars`` is sent in slices of its hashes, each
    in a pass of its own over the texts; the result is the same.
    """
    known = stored(known, "item-windows")
    chars = F.length(F.array_join("window", " ")) + 20 * F.size("items") + 40
    measured = known.agg(F.sum(chars).alias("chars"), F.sort_array(F.collect_set("size")).alias("sizes")).first()
    slices = -(-(measured.chars or 0) // sent_chars)
    own = docs.select("doc_id", _key(F.col("text")).alias("digest"), words(F.col("text")).alias("w"))
    looked = F.concat(*[windows(F.col("w"), size) for size in measured.sizes]) if measured.sizes else windows(F.col("w"), 1)
    placed = own.select("doc_id", "digest", "w", F.inline(looked))
    found = None
    for k in range(max(slices, 1)):
        part = known.filter(F.pmod("hash", F.lit(max(slices, 1))) == k).withColumnRenamed("size", "_size")
        same = (F.col("size") == F.col("_size")) & (F.slice("w", F.col("at") + 1, F.col("size")) == F.col("window"))
        hits = placed.join(F.broadcast(part), "hash").filter(same).select("doc_id", "digest", "at", "size", "items")
        found = hits if found is None else found.union(hits)
    return found.groupBy("doc_id", "digest").agg(
        F.collect_set(F.struct("at", "size")).alias("hits"), F.collect_set("items").alias("items")
    )


def covered(hits: Column) -> Column:
    """The sorted positions of all words inside a hit."""
    inside = F.transform(hits, lambda h: F.sequence(h["at"], h["at"] + h["size"] - 1))
    return F.sort_array(F.array_distinct(F.flatten(inside)))


def spans_of(places: str) -> Column:
    """The runs in a column of sorted positions as ``first`` and ``past``."""

    def edges(step: int) -> Column:
        return F.filter(
            places, lambda p, i: F.coalesce(F.get(F.col(places), i + step) != p + step, F.lit(True))
        )

    kind = "array<struct<first:int,past:int>>"
    return F.zip_with(
        edges(-1), edges(1), lambda a, b: F.struct(a.alias("first"), (b + 1).alias("past"))
    ).cast(kind)


def scan(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_hit, spans, items, contaminated``.

    ``spans`` are runs of words inside windows of ``items`` (word positions from
    0, ``past`` not included), ``items`` the sorted ids of items that have a
    window here. A null or empty text has no words and no hit. Rows that repeat
    an id or lack one are told apart by their text; rows equal in both get equal
    results. An item without words matches nothing; one without id marks words
    but is not listed. Without items every row is clean, without rows the result
    is empty. Other columns of ``docs`` are left out.
    """
    hits = window_hits(docs, item_windows(items, size)).select(
        F.col("doc_id").alias("_id"),
        F.col("digest").alias("_digest"),
        covered(F.col("hits")).alias("places"),
        F.array_distinct(F.flatten("items")).alias("found"),
    )
    own = docs.select(
        "doc_id", _key(F.col("text")).alias("digest"), F.size(words(F.col("text"))).cast("long").alias("n_words")
    )
    joined = own.join(hits, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    nothing = F.array().cast("array<int>")
    joined = joined.select("doc_id", "digest", "n_words", F.coalesce("places", nothing).alias("places"), "found")
    none = F.array().cast(joined.schema["found"].dataType)
    return joined.select(
        "doc_id",
        "digest",
        "n_words",
        F.size("places").cast("long").alias("n_hit"),
        spans_of("places").alias("spans"),
        F.coalesce("found", none).alias("items"),
        (F.size("places") > 0).alias("contaminated"),
    )


def _matched(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """``docs`` as one struct ``row`` joined to what ``scan`` found in its contaminated texts."""
    hit = found.filter("contaminated").select(
        F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "spans"
    ).distinct()
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    keyed = row.select("row", _key(F.col("row.text")).alias("_key"))
    return keyed.join(hit, F.col("row.doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_digest")), how)


def without_documents(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, all columns, whose texts hold no window of ``items``; others are told by ``scan``."""
    return _matched(docs, scan(docs, items, size), "left_anti").select("row.*")


def without_spans(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs``, all columns, with the words of every hit taken out of ``text``.

    What stands between the words stays, as do texts without a hit, letter for letter.
    """
    text = F.coalesce(F.col("row.text"), F.lit(""))
    cut = _matched(docs, scan(docs, items, size), "left").select(
        "row",
        "spans",
        F.when(F.col("spans").isNotNull(), F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).alias("_words"),
        F.when(F.col("spans").isNotNull(), F.split(text, WORD, -1)).alias("_gaps"),
        F.array_distinct(
            F.flatten(F.transform("spans", lambda s: F.sequence(s["first"], s["past"] - 1)))
        ).alias("_hit"),
    )
    # positions of the words that stay, each with the gap before it; gaps of words taken out stay too
    stays = F.array_except(F.sequence(F.lit(0), F.size("_words") - 1), F.col("_hit"))
    kept = F.map_from_arrays(stays, F.transform(stays, lambda i: F.get(F.col("_words"), i)))
    parts = F.transform(
        "_gaps", lambda gap, i: F.concat(gap, F.coalesce(F.try_element_at(kept, i), F.lit("")))
    )
    text = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(F.array_join(parts, ""))
    return cut.select(F.col("row").withField("text", text).alias("row")).select("row.*")
