import math
import re

from lodestone.operators import postings as X

TEXTS = {
    1: "The quick brown fox, the LAZY dog; the end",
    2: "",
    3: "Straße 42 straße über 42",
    4: None,
    5: "the the the",
    6: "dog fox",
    7: "--- ...",
}


def terms(text):
    return re.findall(r"[^\W_]+", text.lower())


def frame(spark):
    return spark.createDataFrame(list(TEXTS.items()), "row_key long, text string")


def test_postings(spark):
    wanted = {}
    for key, text in TEXTS.items():
        for at, term in enumerate(terms(text or "")):
            wanted.setdefault((key, term), []).append(at)
    found = X.postings(frame(spark), "text").collect()
    assert {(r.row_key, r.term): r.positions for r in found} == wanted
    assert len(found) == len(wanted)
    assert all(r.tf == len(r.positions) and r.row_terms == len(terms(TEXTS[r.row_key])) for r in found)
    counted = X.term_counts(frame(spark), "text").collect()
    narrow = lambda rows: sorted((r.row_key, r.term, r.row_terms, r.tf) for r in rows)
    assert narrow(counted) == narrow(found)


def test_building_postings_shuffles_nothing(spark):
    plan = X.postings(frame(spark), "text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_term_stats(spark):
    found = {r.term: (r.row_count, r.occurrences) for r in X.term_stats(X.postings(frame(spark), "text")).collect()}
    assert found["the"] == (2, 6) and found["fox"] == (2, 2) and found["42"] == (1, 2)


def brute(query):
    held = {k: terms(t) for k, t in TEXTS.items() if t is not None}
    mean = sum(map(len, held.values())) / len(held)
    scores = {}
    for term in set(terms(query)):
        n = sum(term in t for t in held.values())
        for key, words in held.items():
            tf = words.count(term)
            if tf:
                idf = math.log(1 + (len(held) - n + 0.5) / (n + 0.5))
                length = 1 - X.B + X.B * len(words) / mean
                scores[key] = scores.get(key, 0) + idf * tf * (X.K1 + 1) / (tf + X.K1 * length)
    return sorted(((-round(s, 9), k) for k, s in scores.items()))


def test_keyword_search(spark, monkeypatch):
    asked = {"a": "the Fox the", "b": "dog 42 nothing", "c": "nothing"}
    queries = spark.createDataFrame(list(asked.items()), "query_id string, text string")
    index = X.postings(frame(spark), "text")
    corpus = X.corpus_stats(frame(spark), "text", X.term_stats(index))
    assert corpus.first().rows == 6
    for bound in (X.QUERY_TERMS, 0):
        monkeypatch.setattr(X, "QUERY_TERMS", bound)
        found = X.keyword_search(index, X.term_stats(index), corpus, queries, 2).collect()
        got = {}
        for r in sorted(found, key=lambda r: r["rank"]):
            got.setdefault(r.query_id, []).append((-r.score, r.row_key))
        assert got == {q: brute(t)[:2] for q, t in asked.items() if brute(t)}


def test_a_task_counts_a_bounded_stretch_of_text(spark, monkeypatch):
    few = X.term_counts(frame(spark), "text")
    monkeypatch.setattr(X, "COUNTED_BYTES", 2)
    many = X.term_counts(frame(spark), "text")
    assert many.rdd.getNumPartitions() > few.rdd.getNumPartitions()
    assert sorted(map(str, many.collect())) == sorted(map(str, few.collect()))
