import hashlib

import corpus_pipeline
import duckdb
import parity
import public_tokenizers
import pytest
import tiktoken
from helpers import linked_components

from lodestone.llm import bpe
from lodestone.llm.queries import ORACLE, QUERIES

SMALL = "/root/testdata/sf0.001"
NATIVE = ("op2_license_scan", "op6_url_filter", "op8_quality_rules", "op12_decontaminate")


FRAMES = {}


def query(spark, name):
    """A query's frame, built once: building some of them runs whole jobs."""
    if name not in FRAMES:
        FRAMES[name] = QUERIES[name](spark, SMALL)
    return FRAMES[name]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    assert parity.compare(spark, SMALL, name, lambda *_: query(spark, name), ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_in_plan(spark, name):
    found = query(spark, name)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in found and "NestedLoopJoin" not in found
    if name in NATIVE:
        assert "Python" not in found and "Arrow" not in found and "Pandas" not in found


def documents():
    return duckdb.sql(f"SELECT doc_id, text, source FROM '{SMALL}/documents.parquet' ORDER BY 1").fetchall()


def test_near_duplicates_of_the_table(spark):
    found = query(spark, "op4_jaccard_join").collect()
    assert sorted(map(tuple, found)) == sorted(linked_components(documents(), 4, 85))


def test_language_accuracy(spark):
    lang = dict(duckdb.sql("SELECT doc_id, lang FROM '/root/testdata/sf0.01/documents.parquet'").fetchall())
    held = [r for r in QUERIES["op7_language_id"](spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)


def test_pipeline(spark):
    """Each stage's decision against brute force over the rows of the stage before."""
    rows = documents()
    found = corpus_pipeline.run(spark, SMALL).collect()
    texts = {d: t for d, t, _ in rows}
    best = {}
    for d, t, _ in rows:
        if any(c.isalpha() for c in t):
            best[t] = max(d, best.get(t, d))
    unique = sorted((d, t) for t, d in best.items())
    stay = {d for d, _, c in linked_components(unique, 5, 80) if d == c}
    ids = [r.doc_id for r in found]
    assert set(ids) <= stay and len(set(ids)) >= 0.9 * len(stay)
    assert max(ids.count(d) for d in set(ids)) <= 2
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in found:
        assert list(r.ids) == library.encode_ordinary(texts[r.doc_id])
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
