"""Licence texts by the digest of their canonical form.

Canonical form: lower case, copyright lines gone, equivalent spellings made one,
punctuation and runs of white space turned to single spaces. A licence is found
where a whole unit has its digest: the text, one of its paragraphs or one of its
lines, and where its paragraphs follow each other. Column functions only.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import has_at_most

#: Known digests up to which the known side is sent to the tasks; beyond it both sides are dealt by digest.
SENT_DIGESTS = 10_000

# Spellings that licence comparison treats as equal, the second one is used.
SPELLINGS = (
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("sub license", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("merchantibility", "merchantability"),
    ("per cent", "percent"),
    ("owner", "holder"),
    ("favour", "favor"),
    ("organisation", "organization"),
)

# Public licence texts and notices.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
KNOWN = (
    ("MIT", MIT),
    ("MIT", "MIT License\n\n" + MIT),
    ("MIT", "The MIT License (MIT)\n\n" + MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("ISC", ISC),
    ("ISC", "ISC License\n\n" + ISC),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
)

#: Lines that only say who holds the rights.
COPYRIGHT_LINE = "(^|\\n)[ \\t]*[#/*;%-]*[ \\t]*(copyright|\\(c\\)|©)[^\\n]*[0-9]{4}[^\\n]*"

#: The same without a year, told from prose by its sign or its blanks to fill in.
HOLDER_LINE = (
    "(^|\\n)[ \\t]*[#/*;%-]*[ \\t]*(copyright[ \\t]*(\\(c\\)|©|<|\\[|\\{)|\\(c\\)[ \\t]*copyright|©)[^\\n]*"
)

#: Where the terms of a licence end and advice on its use begins.
TERMS_END = re.compile(r"(?m)^[ \t]*(END OF TERMS AND CONDITIONS|Exhibit A - Form of Source Code|EXHIBIT A)")


def whole_texts() -> list[tuple[str, str]]:
    """Licence id and text of the files in ``licenses``, with and without what follows their terms.

    What a file's name has after ``+`` tells texts of one licence apart.
    """
    found = []
    for path in sorted((Path(__file__).parent / "licenses").glob("*.txt")):
        text, name = path.read_text("utf-8"), path.stem.split("+")[0]
        found.append((name, text))
        if end := TERMS_END.search(text):
            found += [(name, text[: end.start()]), (name, text[: end.end()])]
    return found


def tidy(text: Column) -> Column:
    """The canonical form but for white space, so that lines and paragraphs still show."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "$1")
    out = F.regexp_replace(out, HOLDER_LINE, "$1")
    for spelling, used in SPELLINGS:
        out = F.replace(out, F.lit(spelling), F.lit(used))
    return F.regexp_replace(out, "[^\\p{L}\\p{N}\\n]+", " ")


def canonical(unit: Column) -> Column:
    return F.trim(F.regexp_replace(unit, "[ \\n]+", " "))


def paragraphs(t: Column) -> Column:
    """Canonical forms of the paragraphs of a tidy text, without empty ones."""
    return F.filter(F.transform(F.split(t, "\\n *\\n"), canonical), lambda p: p != "")


def units(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``row`` and, one by one, the canonical units of the text.

    ``kind`` is 0 for the text, 1 for a paragraph and 2 for a line; ``place``
    counts the paragraphs.
    """
    step = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), tidy(F.col("text")).alias("t"))

    def named(kind: int, forms: Column) -> Column:
        return F.transform(
            forms, lambda p, i: F.struct(p.alias("form"), F.lit(kind).alias("kind"), i.alias("place"))
        )

    every = F.concat(
        named(0, F.array(canonical(F.col("t")))),
        named(1, paragraphs(F.col("t"))),
        named(2, F.transform(F.split("t", "\n"), canonical)),
    )
    return step.select("doc_id", "row", F.explode(every).alias("u")).select("doc_id", "row", "u.*").filter("form <> ''")


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """Digests of licence texts, given as pairs or as a table of ``license_id`` and ``text``.

    ``license_id, digest, whole, at, size``: of every text its own digest, without
    ``at``, and where it has several paragraphs (``size``) those of each, ``at`` its place.
    """
    rows = known if isinstance(known, DataFrame) else spark.createDataFrame(list(known), "license_id string, text string")
    rows = rows.select("license_id", tidy(F.col("text")).alias("t"))
    forms = rows.select("license_id", F.sha2(canonical(F.col("t")), 256).alias("own"), paragraphs(F.col("t")).alias("p"))
    own = F.array(F.struct(F.col("own").alias("digest"), F.lit(None).cast("int").alias("at"), F.lit(1).alias("size")))
    parts = F.transform("p", lambda p, i: F.struct(F.sha2(p, 256).alias("digest"), i.alias("at"), F.size("p").alias("size")))
    every = F.explode(F.when(F.size("p") > 1, F.concat(own, parts)).otherwise(own)).alias("u")
    # one form may be cut into paragraphs in several ways
    cut = F.sha2(F.array_join("p", "\n"), 256)
    return (
        forms.select("license_id", cut.alias("cut"), every)
        .select("license_id", "u.digest", F.when(F.col("u.at").isNotNull(), F.col("cut")).alias("whole"), "u.at", "u.size")
        .distinct()
    )


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """One row per document and licence found in it: ``doc_id, license_id, unit, matches``.

    ``unit`` is the widest one that matched: text, paragraph (one, or all of a
    licence in a row) or line; ``matches`` counts matching lines, or 1 where only
    a wider unit matched. Null and empty texts match nothing; repeated rows are
    reported each.
    """
    digest = units(docs.select("doc_id", "text")).withColumn("digest", F.sha2("form", 256))
    side = F.broadcast(known) if has_at_most(known, SENT_DIGESTS) else known
    hits = digest.join(side, "digest").filter("at IS NULL OR kind = 1")
    # the paragraphs of one licence text in one run have the same difference of places
    runs = hits.groupBy("row", "license_id", "whole", (F.col("place") - F.col("at")).alias("start"), "size").agg(
        F.first("doc_id").alias("doc_id"),
        F.min("kind").alias("kind"),
        F.count_if(F.col("kind") == 2).alias("lines"),
        F.count("*").alias("n"),
    )
    found = runs.filter("whole IS NULL OR n = size").groupBy("row", "license_id").agg(
        F.first("doc_id").alias("doc_id"),
        F.min("kind").alias("kind"),
        F.greatest(F.sum("lines"), F.lit(1)).alias("matches"),
    )
    unit = F.element_at(F.array(F.lit("text"), F.lit("paragraph"), F.lit("line")), F.col("kind") + 1)
    return found.select("doc_id", "license_id", unit.alias("unit"), "matches")
