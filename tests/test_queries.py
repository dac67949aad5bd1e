"""Every registered query against its SQL, and the shape of the plans."""

import pytest
from parity import compare

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
# the queries of the corpus part have their tests beside it
QUERIES = {name: q for name, q in entry.queries().items() if q.__module__.startswith("lodestone.plans")}
SQL = {name: sql for name, sql in entry.oracle_sql().items() if name in QUERIES}
FRAMES = {}


def frame(spark, name):
    """A query's frame, built once: building some of them runs whole jobs."""
    if name not in FRAMES:
        FRAMES[name] = QUERIES[name](spark, FOLDER)
    return FRAMES[name]


JVM_ONLY = [
    "scan_all_content", "in_metadata", "row_cap", "chat_history", "chat_messages", "prompt_render",
    "request_json", "chunk_text", "chunk_code", "log_context", "postings", "bm25", "upsert",
]


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    assert compare(spark, FOLDER, name, lambda *_: frame(spark, name), SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_without_sql(spark, name):
    assert frame(spark, name).count() > 0


def plan(spark, name):
    return frame(spark, name)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", JVM_ONLY)
def test_no_python_in_plan(spark, name):
    found = plan(spark, name)
    assert "Python" not in found and "Arrow" not in found and "Pandas" not in found


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_in_plan(spark, name):
    found = plan(spark, name)
    assert "CartesianProduct" not in found and "NestedLoopJoin" not in found


def test_top_k_is_cut_before_the_shuffle(spark):
    for name in ("knn_cosine_batch", "bm25"):
        assert "WindowGroupLimit" in plan(spark, name)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
