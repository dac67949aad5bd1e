"""Benchmark decontamination and the filter audit against brute force."""

import re
from itertools import permutations

import numpy as np
import pytest
from helpers import LOWER, PROSE, WORD, awkward, crowded, frame

from lodestone.llm import decontaminate, filter_audit
from lodestone.llm.tables import ready

ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = [
    (1, "Gamma10 ALPHA11beta4 gamma11 alpha12beta5 gamma12 alpha0beta6 gamma13 alpha1beta0 gamma14 alpha2beta1 gamma15"),
    (2, "two-words"),
    (3, None),
    (4, " \n!"),
    (5, "the the"),
    (6, "nothing of this item occurs anywhere in the given texts at all"),
    (7, "the the"),
    (None, "again and again"),
    (10, "É ß 中文"),
]


def item_words(text):
    return ITEM_WORD.findall((text or "").translate(LOWER))


def brute_hits(text, items, size=10):
    own = item_words(text)
    hit, found = set(), set()
    for item_id, item in items:
        words = item_words(item)
        n = min(size, len(words))
        for k in range(len(words) - n + 1 if n else 0):
            for i in range(len(own) - n + 1):
                if own[i : i + n] == words[k : k + n]:
                    hit.update(range(i, i + n))
                    if item_id is not None:
                        found.add(item_id)
    return len(own), sorted(hit), sorted(found)


def items_frame(spark, items=ITEMS):
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("sent", [1 << 24, 200])
def test_hits_of_awkward_rows(spark, sent, monkeypatch):
    monkeypatch.setattr(decontaminate.window_hits, "__defaults__", (sent,))
    rows = awkward() + [(50, "Two.\x00Words!", None, None), (51, "x é ß 中文", None, None), (52, "É ß 中文", None, None)]
    found = decontaminate.scan(crowded(frame(spark, rows)), items_frame(spark)).collect()
    got, wanted = [], []
    for r in found:
        places = [p for s in r.spans for p in range(s.first, s.past)]
        got.append((r.doc_id, r.n_words, r.n_hit, places, r.items, r.contaminated))
        assert all(a.past < b.first for a, b in zip(r.spans, r.spans[1:]))
    for row in rows:
        n, hit, ids = brute_hits(row[1], ITEMS)
        wanted.append((row[0], n, len(hit), hit, ids, bool(hit)))
    assert sorted(got, key=str) == sorted(wanted, key=str)
    assert any(w[5] for w in wanted) and not all(w[5] for w in wanted)


def test_documents_and_spans_taken_out(spark):
    docs = crowded(frame(spark, awkward() + [(60, "Keep this: two words, and that.", None, None)]))
    items = items_frame(spark)
    clean = decontaminate.without_documents(docs, items)
    assert clean.columns == docs.columns
    wanted = [r[0] for r in awkward() if not brute_hits(r[1], ITEMS)[1]]
    assert sorted((r.doc_id for r in clean.collect()), key=str) == sorted(wanted, key=str)
    cut = decontaminate.without_spans(docs, items)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert texts[60] == "Keep this:  , and that." and texts[5] is None and texts[12] == "x" * 300_000
    assert item_words(texts[1]) == [w for k, w in enumerate(item_words(PROSE)) if k not in set(brute_hits(PROSE, ITEMS)[1])]


def test_no_items_and_no_rows(spark):
    docs, none = frame(spark), items_frame(spark, [])
    assert not any(r.contaminated or r.n_hit or r.items for r in decontaminate.scan(docs, none).collect())
    assert decontaminate.scan(docs, none).count() == docs.count()
    assert decontaminate.scan(frame(spark, []), items_frame(spark)).count() == 0
    assert decontaminate.without_spans(docs, none).count() == docs.count()


def test_no_python_on_the_main_path(spark):
    found = decontaminate.scan(frame(spark), items_frame(spark))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan and "Nested" not in plan and "Cartesian" not in plan


def fails(rows):
    out = []
    for doc_id, text, _, source in rows:
        text = text or ""
        words = WORD.findall(text)
        out.append(
            (
                len(words) < 200,
                100 * len(set(words)) < 50 * len(words),
                100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
                any(c in "#$%&*|" for c in text),
                doc_id is not None and any(r[0] is not None and r[0] < doc_id and (r[1] or "") == text for r in rows),
            )
        )
    return out


def brute_audit(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    out, marks = {}, fails(rows)
    for part in {r[3] or "" for r in rows}:
        own = [(r[0], f) for r, f in zip(rows, marks) if (r[3] or "") == part]
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                k = "ABCDE".index(letter)
                gone = [x for x in left if x[1][k]]
                left = [x for x in left if not x[1][k]]
                out[part, "".join(order), step] = [
                    len(left),
                    len(gone),
                    sum(f[k] for _, f in own) - len(gone),
                    sum(f[k] and sum(f) == 1 for _, f in own),
                    sum(d in good for d, _ in gone),
                    sum(d in toxic for d, _ in gone),
                ]
        for letter in "ABCDE":
            places = [x for x in out if x[0] == part and x[1][x[2] - 1] == letter]
            total = sum(out[x][1] for x in places)
            for x in places:
                out[x].append(total)
    return {k: tuple(v) for k, v in out.items()}


LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (3, None, 1), (11, 1, 1), (14, 1, 0), (None, 1, 1), (999, 1, 1)]


def test_audit_of_awkward_rows(spark):
    ready(spark)
    rows = awkward() + [(70, "#" + PROSE, None, ""), (71, PROSE, None, "a"), (None, PROSE, None, "a"), (0, "", None, "z")]
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    found = filter_audit.audit(crowded(frame(spark, rows)), labels).collect()
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in found}
    assert len(got) == len(found) == 600 * len({r[3] or "" for r in rows})
    assert got == brute_audit(rows, LABELS)


def test_audit_of_nothing(spark):
    ready(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(frame(spark, []), none).count() == 0
    assert filter_audit.audit(frame(spark), none).agg({"good_lost": "sum"}).first()[0] == 0


def test_bit_counts():
    rng = np.random.default_rng(3)
    for groups, n in ((1, 0), (1, 1), (1, 5000), (7, 1000), (300, 900)):
        values = rng.integers(0, 2**32, n, dtype=np.uint32)
        group = np.sort(rng.integers(0, groups, n))
        wanted = np.zeros((groups, 32), np.int64)
        np.add.at(wanted, group, (values[:, None] >> np.arange(32, dtype=np.uint32) & 1).astype(np.int64))
        assert (filter_audit.bit_counts(values, group, groups) == wanted).all()
