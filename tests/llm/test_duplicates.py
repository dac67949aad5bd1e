import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from helpers import PROSE, WORD, awkward, crowded, frame, linked_components, plain

from lodestone.llm import chunking, components, exact_dedup, jaccard_join, substring_dedup


def wanted_copies():
    rows = awkward()
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(text or "", []).append(doc_id)
    out = []
    for doc_id, text, *_ in rows:
        own = groups[text or ""]
        keep = max((d for d in own if d is not None), default=None)
        out.append((doc_id, keep, len(own), hashlib.sha256((text or "").encode()).hexdigest()))
    return out


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_duplicates(spark, bits):
    found = exact_dedup.exact_duplicates(crowded(frame(spark)), bits).collect()
    assert plain((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == plain(wanted_copies())
    kept = [r for r in found if r.kept]
    assert len(kept) == len({r.text_sha256 for r in found})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_narrow_fingerprints_collide_and_are_told_apart(spark):
    docs = frame(spark, [(k, f"text number {k // 2}", "en", "a") for k in range(200)])
    assert exact_dedup.collisions(docs, 3)
    assert not exact_dedup.collisions(docs)
    found = exact_dedup.exact_duplicates(docs, 3).collect()
    assert {r.group_size for r in found} == {2}


def test_exact_keeps_one_row_of_each_text(spark):
    docs = crowded(frame(spark))
    found = exact_dedup.keep_exact(docs)
    assert found.columns == docs.columns
    texts = [r.text or "" for r in found.collect()]
    assert sorted(texts) == sorted({t or "" for _, t, *_ in awkward()})
    assert exact_dedup.keep_exact(frame(spark, [])).count() == 0


@pytest.mark.parametrize("limits", [None, (2, 300)])
@pytest.mark.parametrize("size, percent", [(4, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, limits, size, percent):
    if limits:
        monkeypatch.setattr(jaccard_join, "COMPARED", limits[0])
        monkeypatch.setattr(jaccard_join, "REGION_ITEMS", limits[1])
    rows = awkward()
    words = PROSE.split()
    for k in range(60):  # edited copies at all distances around the threshold
        own = list(words)
        for e in range(k % 12):
            own[(k * 7 + e * 19) % len(own)] = f"new{k}x{e}"
        rows.append((100 + k, " ".join(own), "en", "a"))
    docs = crowded(frame(spark, rows)).repartition(5)
    found = jaccard_join.near_duplicates(docs, size, percent)
    wanted = linked_components(rows, size, percent)
    assert plain(found.select("doc_id", "n_shingles", "component_id").collect()) == plain(wanted)
    if limits is None:
        kept = jaccard_join.keep_distinct(docs, size, percent)
        assert kept.columns == docs.columns
        gone = {d for d, _, c in wanted if d != c}
        assert plain((r.doc_id,) for r in kept.collect()) == plain((r[0],) for r in rows if r[0] not in gone)


def test_keep_distinct_with_null_and_repeated_ids(spark):
    words = PROSE.split()

    def edited(k):
        return " ".join([*words[:k], f"edit{k}", *words[k + 1 :]])

    def clean(k):
        return " ".join(f"own{k}word{i}" for i in range(30))

    near = [(5, edited(1)), (None, edited(2)), (None, edited(3)), (6, edited(4)), (6, edited(5))]
    lonely = [(None, clean(1)), (None, clean(2)), (6, clean(3)), (None, ""), (None, None)]
    # groups without an id, and of one id alone
    null_group = [(None, f"{clean(4)} end{k}") for k in range(3)]
    same_group = [(7, f"{clean(5)} end{k}") for k in range(3)]
    # equal sets, different texts
    cased = [(None, clean(6)), (None, clean(6).upper())]
    rows = [(*r, "en", "a") for r in near + lonely + null_group + same_group + cased]
    kept = plain((r.doc_id, r.text) for r in jaccard_join.keep_distinct(crowded(frame(spark, rows)), 5, 80).collect())
    first = [min(group, key=lambda r: hashlib.sha256(r[1].encode()).hexdigest()) for group in (null_group, same_group, cased)]
    assert kept == plain([near[0], *lonely, *first])


def test_near_duplicates_without_rows_or_links(spark):
    assert jaccard_join.near_duplicates(frame(spark, [])).count() == 0
    rows = [(k, f"a{k} b{k} c{k} d{k} e{k} f{k}", "en", "a") for k in range(5)]
    assert {r.component_id for r in jaccard_join.near_duplicates(frame(spark, rows)).collect()} == set(range(5))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 60)] + [(100, 101), (102, 101)], "a long, b long")
    found = {r.node: r.component for r in components.components(edges).collect()}
    assert found == {**{k: 0 for k in range(61)}, 100: 100, 101: 100, 102: 100}


def test_repeated_passages(spark):
    passage = " ".join(f"shared{i}passage" for i in range(52))
    rows = [(k, f"{PROSE.replace('a', chr(98 + k))} {passage} {k}{k} tail{k}", "en", "a") for k in range(4)]
    rows += [(20 + k, " ".join(f"own{k}word{i}" for i in range(200)), "en", "a") for k in range(4)]
    found = substring_dedup.repeated_passages(crowded(frame(spark, rows))).collect()
    assert {r.doc_id for r in found} == {0, 1, 2, 3}
    texts = {r[0]: r[1].encode() for r in rows}
    for r in found:
        span = texts[r.doc_id][r.start_byte : r.end_byte].decode()
        assert span in rows[r.doc_id][1] and abs(len(span.split()) - r.n_words) <= 1 and r.n_words >= 25
        assert "shared20passage shared21passage" in span
    assert sum(r.kept for r in found) == 1
    assert substring_dedup.repeated_passages(frame(spark, [])).count() == 0


def test_repeated_passages_of_awkward_rows(spark):
    rows = awkward() + [(30, "und so weiter " * 40, "de", "a"), (31, "und so weiter " * 30, "de", "a")]
    wanted = passages_by_hand(rows)
    assert {1, 2, 4, 13, 30, 31} <= {w[0] for w in wanted}
    assert not {5, 6, 7, 8, 9, 10, 12, 15, 16} & {w[0] for w in wanted}
    for docs in (frame(spark, rows).coalesce(1), crowded(frame(spark, rows)).repartition(4)):
        found = substring_dedup.repeated_passages(docs)
        assert plain(found.select("doc_id", "start_byte", "end_byte", "n_words").collect()) == plain(wanted)


def passages_by_hand(rows: list[tuple], least: int = 25) -> list[tuple]:
    """(doc_id, start_byte, end_byte, n_words) of every passage, from cuts found word by word."""
    chunked = []
    holders = defaultdict(set)
    for x, (_, text, *_) in enumerate(rows):
        spans = [(m.start(), m.end()) for m in re.finditer(rb"[^ \t-\r]+", (text or "").encode())]
        words = [(text or "").encode()[a:b] for a, b in spans]
        marks = [
            int(chunking.chunk_digests(np.frombuffer(w, np.uint8), np.array([len(w)]))[0]) % 2**64 >> 32 for w in words
        ]
        hashed = [0, *((now + 2 * old) % 2**32 for old, now in zip(marks, marks[1:]))]
        cuts = [i + 1 for i in range(3, len(words) - 2) if hashed[i] == max(hashed[i - 2 : i + 3])]
        ends = sorted({*cuts, len(words)} - {0})
        own = [(a, b, tuple(words[a:b])) for a, b in zip([0, *ends], ends)]
        chunked.append((spans, own))
        for _, _, chunk in own:
            holders[chunk].add(x)
    out = []
    for (doc_id, *_), (spans, own) in zip(rows, chunked):
        run = []
        for a, b, chunk in [*own, (0, 0, None)]:
            if len(holders.get(chunk, ())) > 1:
                run.append((a, b))
                continue
            if run and run[-1][1] - run[0][0] >= least:
                out.append((doc_id, spans[run[0][0]][0], spans[run[-1][1] - 1][1], run[-1][1] - run[0][0]))
            run = []
    return out


@pytest.mark.parametrize("hot_share", [1000, 10**9])
@pytest.mark.parametrize("letters", [1, 2, 3, 7])
def test_repeated_passages_of_short_and_long_words(spark, monkeypatch, letters, hot_share):
    monkeypatch.setattr(substring_dedup, "HOT_SHARE", hot_share)
    dice = random.Random(letters)

    def words(n):
        return ["".join(dice.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=letters)) for _ in range(n)]

    rows = [(1000 + k, " ".join(words(150)), "en", "a") for k in range(40)]
    for k in range(40):
        passage = words(50)
        for copy in range(2):
            text = [*words(dice.randrange(60)), *passage, *words(dice.randrange(60))]
            rows.append((2 * k + copy, "\n ".join(text) if copy else " ".join(text), "en", "b"))
    found = substring_dedup.repeated_passages(frame(spark, rows).repartition(3)).collect()
    assert plain((r.doc_id, r.start_byte, r.end_byte, r.n_words) for r in found) == plain(passages_by_hand(rows))
    texts = {r[0]: r[1] for r in rows}
    assert all(len(WORD.findall(texts[r.doc_id][r.start_byte : r.end_byte])) == r.n_words for r in found)
    # every document with a passage is found; with words of one letter, chance repeats join what lies beside it
    assert set(range(80)) <= {r.doc_id for r in found}
    if letters > 2:
        assert {r.doc_id for r in found} == set(range(80))
    kept = {r.doc_id // 2 for r in found if r.kept and r.doc_id < 1000}
    assert letters < 3 or kept == set(range(40))


def test_near_duplicates_of_many_rows_without_an_id(spark):
    def text(k):
        return " ".join(f"own{k // 2}word{i}" for i in range(20)) + f" end{k}"

    # pairs of near copies, all without an id, and one text that fills a third of the rows
    rows = [(None, text(k), "en", "a") for k in range(3000)] + [(7, text(0), "en", "a")] * 1500
    found = jaccard_join.near_duplicates(frame(spark, rows), 4, 85).collect()
    assert len(found) == len(rows)
    assert sum(r.doc_id == 7 and r.component_id == 7 for r in found) == 1500
    # the texts of the first pair share the component that has an id
    assert sum(r.doc_id is None and r.component_id == 7 for r in found) == 2
    kept = jaccard_join.keep_distinct(frame(spark, rows), 4, 85).collect()
    assert sum(r.doc_id is None for r in kept) == 1499 and sum(r.doc_id == 7 for r in kept) == 1500
