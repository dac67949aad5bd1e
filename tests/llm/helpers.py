"""Small corpora with every awkward case, and brute-force versions of the operators."""

from __future__ import annotations

import re
from collections import defaultdict

WORD = re.compile(r"[^ \t-\r]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string"
PROSE = " ".join(f"alpha{i % 13}beta{i % 7} gamma{i}" for i in range(120))


def awkward() -> list[tuple]:
    """Nulls in every column, empty and long texts, copies, near copies, repeated rows, odd characters."""
    near = PROSE.replace("gamma50 ", "delta ")
    return [
        (1, PROSE, "en", "a"),
        (2, PROSE, "en", "b"),
        (3, PROSE.upper(), "en", None),
        (4, near, None, "b"),
        (5, None, None, None),
        (6, "", "en", "a"),
        (7, " \n\t", "de", "c"),
        (8, "one", "de", "c"),
        (9, "ONE", "de", "c"),
        (10, "two words\x1c here é ß 中文 \U0001f600   it's we'll 123 4.5", "fr", "c"),
        (11, "the " * 3000, "en", "a"),
        (12, "x" * 300_000, "en", "a"),
        (13, "start " + PROSE + " end\n" + PROSE, "en", "d"),
        (None, "no id here " * 4, "en", "a"),
        (None, "no id here " * 4, "en", "a"),
        (14, "again and again", "en", "a"),
        (14, "again and again", "en", "a"),
        (15, "1234 5678 !!", "en", "d"),
        (16, "line one is here\nline one is here\nother\n\n\n#|<>", "fr", "d"),
    ]


def frame(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)


def crowded(docs):
    """The same rows with columns that an operator might use itself."""
    from pyspark.sql import functions as F

    names = "row words kept shard place recipe node items n size taken before last target rejected digest _doc_id _size"
    return docs.withColumns({name: F.lit("x") for name in names.split()})


def shingles(text: str | None, size: int) -> frozenset:
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))) if words else frozenset()


def linked_components(rows: list[tuple], size: int, percent: int) -> list[tuple]:
    """(doc_id, n_shingles, component_id) of every row, by comparing all texts that share a shingle."""
    sets = [shingles(text, size) for _, text, *_ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for x, own in enumerate(sets):
        common = defaultdict(int)
        for shingle in own:
            for y in holders[shingle]:
                common[y] += 1
            holders[shingle].append(x)
        for y, n in common.items():
            if 100 * n >= percent * (len(own) + len(sets[y]) - n):
                parent[root(x)] = root(y)
    least = defaultdict(list)
    for x, row in enumerate(rows):
        if row[0] is not None:
            least[root(x)].append(row[0])
    return [(row[0], len(sets[x]), min(least[root(x)], default=None)) for x, row in enumerate(rows)]


def plain(rows) -> list:
    return sorted(map(tuple, rows), key=str)
