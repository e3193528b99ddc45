"""Physical plans of the registered queries."""

import re
from pathlib import Path

import pytest
from test_oracle import FOLDER

import __spark_entry__ as entry

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")

UNWANTED = ["CartesianProduct", "NestedLoopJoin", "SinglePartition", "BatchEvalPython", "LocalLimit"]


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_no_query_gathers_or_crosses_rows(spark, plan, name):
    text = plan(entry.queries()[name](spark, FOLDER))
    assert not [word for word in UNWANTED if word in text]


def exchanges(text):
    return len(re.findall(r"^\(\d+\) Exchange", text, flags=re.MULTILINE))


@pytest.mark.parametrize(
    "name,count",
    [
        # What few files need to be spread over the cores is the one exchange here.
        ("chunk_fixed", 1),
        ("chunk_recursive", 1),
        ("document_meta", 1),
        ("ingest_documents", 1),
        ("ingest_errors", 1),
        ("hashed_embedding", 1),
        ("extractive_summary", 1),
        ("landing_names", 0),
        ("document_uuid", 0),
        ("clean_response", 0),
        ("visible_turns", 0),
        ("latest_one", 0),
        ("admitted_turns", 1),
        ("turn_history", 1),
        ("latest_document", 1),
        # Spreading the files, and two steps in which candidates are merged.
        ("vector_topk", 3),
    ],
)
def test_number_of_shuffles(spark, plan, name, count):
    assert exchanges(plan(entry.queries()[name](spark, FOLDER))) == count


@pytest.mark.parametrize(
    "name,columns",
    [
        ("chunk_fixed", "doc_id:bigint,text:string"),
        ("document_uuid", "doc_id:bigint,lang:string,source:string,n_chars:bigint"),
        ("latest_document", "o_orderkey:bigint,o_custkey:bigint,o_orderdate:timestamp_ntz"),
        ("conversation_cap", "conv_id:bigint"),
        ("chat_segments", "event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string"),
    ],
)
def test_only_needed_columns_are_read(spark, plan, name, columns):
    text = plan(entry.queries()[name](spark, FOLDER))
    assert f"ReadSchema: struct<{columns}>" in text


def test_filters_are_pushed_to_the_scan(spark, plan):
    assert "EqualTo(o_custkey,7)" in plan(entry.queries()["latest_one"](spark, FOLDER))
