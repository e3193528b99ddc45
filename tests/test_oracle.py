"""Every registered query against its SQL counterpart."""

import os
import re
from pathlib import Path

import oracle
import pytest
from test_chunking import SEPARATORS, chunks_by_lists

import __spark_entry__ as entry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")

WITHOUT_SQL = {"chunk_recursive", "vector_topk_quantised"}
OF_LLM = re.compile(r"op\d+_|pipeline$").match


@pytest.fixture(scope="module")
def connection():
    return oracle.connect(FOLDER)


def test_every_query_has_sql_or_own_tests():
    without = set(entry.queries()) - set(entry.oracle_sql())
    assert {name for name in without if not OF_LLM(name)} == WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, connection, name):
    found = entry.queries()[name](spark, FOLDER)
    columns, rows = oracle.expected(connection, entry.oracle_sql()[name])
    assert sorted(columns) == sorted(found.columns)
    got = oracle.rows_of(found.columns, [tuple(row) for row in found.collect()])
    assert got == oracle.rows_of(columns, rows)
    assert got


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_query_runs(spark, name):
    assert entry.queries()[name](spark, FOLDER).count() > 0


def test_recursive_chunks_follow_the_rules_on_whole_documents(spark):
    table = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    expected = {
        (row.doc_id, i): chunk
        for row in table
        for i, chunk in enumerate(chunks_by_lists(row.text, 1000, 200, SEPARATORS))
    }
    rows = entry.queries()["chunk_recursive"](spark, FOLDER).collect()
    assert {(row.document_id, row.chunk_index): row.chunk_text for row in rows} == expected


def test_approximate_search_finds_most_of_the_exact_hits(spark):
    def hits(name):
        rows = entry.queries()[name](spark, FOLDER).collect()
        return {(row.query_id, row.document_id) for row in rows}

    exact, near = hits("vector_topk"), hits("vector_topk_approximate")
    assert len(exact & near) / len(exact) > 0.7


def test_approximate_search_finds_the_true_neighbours_besides_the_question_itself(spark):
    def others(name):
        rows = entry.queries()[name](spark, FOLDER).collect()
        return {(r.query_id, r.document_id) for r in rows if r.query_id != r.document_id}

    exact, near = others("vector_topk"), others("vector_topk_approximate")
    assert len(exact & near) >= 0.9 * len(exact)


def test_entry(spark):
    result = entry.entry(spark)
    assert result.columns == ["query_id", "query", "context", "prompt"]
    assert result.count() == 40


def test_every_tasks_error_text_occurs(spark):
    from paperloom.fixed_values import ERROR_PREFIXES

    responses = [r.response for r in entry.queries()["agent_errors"](spark, "/root/testdata/sf0.01").collect()]
    for prefix in ERROR_PREFIXES.values():
        assert any(response.startswith(prefix) for response in responses)
