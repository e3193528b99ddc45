"""The pipeline against its stages done by hand, and SQL of the queries that have it."""

import os

import oracle
import pytest
from test_decontamination import least_edits
from test_line_dedup import by_brute_force as without_lines
from test_near_dedup import by_brute_force as classes_of

import corpus_pipeline
from paperloom.llm.decontamination import words_of
from paperloom.llm.language_id import identify
from paperloom.llm.oracles import ORACLES
from paperloom.llm.piece_encoding import PieceTable
from paperloom.llm.queries import QUERIES, tokenizer_file

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    found = QUERIES[name](spark, FOLDER)
    columns, rows = oracle.expected(oracle.connect(FOLDER), ORACLES[name])
    assert sorted(columns) == sorted(found.columns)
    got = oracle.rows_of(found.columns, [tuple(row) for row in found.collect()])
    assert got == oracle.rows_of(columns, rows)


def test_one_query_for_each_operator():
    assert [name.split("_")[0] for name in QUERIES] == [f"op{n}" for n in range(1, 14)]


def test_pipeline_equals_its_stages_by_hand(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = {r.doc_id for r in identify(docs).collect() if r.kept}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept]
    assert len(rows) >= 0.98 * docs.count()
    rows = [(i, text) for i, text, _, _ in without_lines(rows)]
    rows = [row for row in rows if dict((i, c) for i, _, c in classes_of(rows, 5))[row[0]] == row[0]]
    items = [words_of(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]

    def leaks(text):
        words = words_of(text)
        threes = set(zip(words, words[1:], words[2:]))
        return any(
            not threes.isdisjoint(zip(item, item[1:], item[2:]))
            and least_edits(item, words) <= int(0.2 * len(item))
            for item in items
        )

    table = PieceTable(tokenizer_file("piece_bpe_32k.model"))
    want = {i: table.encode(text).tolist() for i, text in rows if not leaks(text)}
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id: list(r.ids) for r in got} == want and len(got) == len(want)
    assert all(r.n_tokens == len(r.ids) for r in got)


def test_stages_keep_columns_and_take_odd_rows(spark):
    rows = [
        (1, None, "en", "s", 0), (2, "", None, None, None), (None, "the and of " * 9, "en", "s", 9),
        (3, "the and of " * 9, "en", "s", 9), (3, "the and of " * 9, "en", "s", 9),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    frame = spark.createDataFrame(rows, schema)
    for docs in (frame, frame.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, FOLDER)
            assert docs.columns == frame.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() <= 5
