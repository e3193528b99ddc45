import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.operators import chunking
from paperloom.operators.chunking import RecursiveSplitter

SEPARATORS = ["\n\n", "\n", ".", "!", "?", ",", " ", ""]


def pieces_of(text, separator):
    """Cut before each occurrence, by plain string operations."""
    if separator == "":
        return list(text)
    first, *rest = text.split(separator)
    return [piece for piece in [first, *[separator + one for one in rest]] if piece]


def chunks_by_lists(text, size, overlap, separators):
    """The chunking rules applied to lists of strings."""
    used = next(i for i, s in enumerate(separators) if s in text)
    chunks, run = [], []

    def pack():
        held = []
        for piece in run:
            if held and len("".join(held)) + len(piece) > size:
                chunks.append("".join(held))
                while held and (
                    len("".join(held)) > overlap or len("".join(held)) + len(piece) > size
                ):
                    held.pop(0)
            held.append(piece)
        if held:
            chunks.append("".join(held))
        run.clear()

    for piece in pieces_of(text, separators[used]):
        if len(piece) < size:
            run.append(piece)
            continue
        pack()
        chunks.extend(
            chunks_by_lists(piece, size, overlap, separators[used + 1 :])
            if separators[used + 1 :]
            else [piece]
        )
    pack()
    return [chunk.strip() for chunk in chunks if chunk.strip()]


ALPHABET = st.text(alphabet="ab\n.!?, é😀", max_size=120)


@settings(max_examples=400, deadline=None)
@given(ALPHABET, st.integers(2, 20), st.integers(0, 19))
def test_splitter_follows_the_rules(text, size, overlap):
    overlap = min(overlap, size - 1)
    splitter = RecursiveSplitter(size, overlap, SEPARATORS)
    assert splitter(text) == chunks_by_lists(text, size, overlap, SEPARATORS)


@settings(max_examples=200, deadline=None)
@given(ALPHABET, st.integers(2, 20), st.integers(0, 19))
def test_splitter_invariants(text, size, overlap):
    overlap = min(overlap, size - 1)
    splitter = RecursiveSplitter(size, overlap, SEPARATORS)
    spans = list(splitter.spans(text, 0, len(text), 0))
    assert all(end - start <= size for start, end in spans)
    assert all(b[0] > a[0] and b[1] > a[1] for a, b in zip(spans, spans[1:]))
    assert all(a[1] - b[0] <= overlap for a, b in zip(spans, spans[1:]))
    assert all(b[0] <= a[1] for a, b in zip(spans, spans[1:]))
    if text:
        assert spans[0][0] == 0 and spans[-1][1] == len(text)
    if len(text.strip()) and len(text) <= size:
        assert splitter(text) == [text.strip()]
    whole = "".join(RecursiveSplitter(size, 0, SEPARATORS)(text))
    assert "".join(whole.split()) == "".join(text.split())


def test_default_sizes():
    splitter = RecursiveSplitter()
    assert splitter("") == [] and splitter(" \n\n ") == []
    assert splitter("x" * 1000) == ["x" * 1000]
    assert [len(chunk) for chunk in splitter("x" * 1001)] == [1000, 201]
    assert [len(chunk) for chunk in splitter("x" * 3000)] == [1000, 1000, 1000, 600]
    paragraphs = "\n\n".join(["a" * 600, "b" * 600, "c" * 100])
    assert splitter(paragraphs) == ["a" * 600, "b" * 600 + "\n\n" + "c" * 100]
    commas = ",".join(["w" * 99] * 30)
    assert all(len(chunk) <= 1000 for chunk in splitter(commas))
    with pytest.raises(ValueError):
        RecursiveSplitter(100, 100)


@pytest.mark.parametrize("size,overlap", [(10, 0), (10, 3), (10, 9), (7, 5), (1, 0)])
def test_fixed_windows(spark, size, overlap):
    shuffled = random.Random(1)
    texts = ["", "a", " \n ", "x" * 10, "x" * 11, "ab😀\né" * 9]
    texts += ["".join(shuffled.choices("ab😀é\n\r", k=k)) for k in range(2, 60, 7)]
    frame = spark.createDataFrame(list(enumerate(texts)), "document_id long, text string")
    found = {}
    for row in chunking.fixed_chunks(frame, size, overlap).collect():
        found[row.document_id, row.chunk_index] = row.chunk_text
    stride, expected = size - overlap, {}
    for i, text in enumerate(texts):
        for n in range(max(-(-(len(text) - overlap) // stride), 1)):
            if text[n * stride : n * stride + size]:
                expected[i, n] = text[n * stride : n * stride + size]
    assert found == expected


def test_recursive_chunks_table(spark, plan):
    texts = [(1, "", "u1"), (2, "a. " * 900, "u2"), (3, "short", "u3"), (4, None, "u4")]
    frame = spark.createDataFrame(texts, "document_id long, text string, uri string")
    rows = chunking.recursive_chunks(frame, ["document_id", "uri"])
    assert "Exchange" not in plan(rows)
    collected = rows.collect()
    failed = [row for row in collected if row.error]
    assert [(row.document_id, row.chunk_index) for row in failed] == [(4, None)]
    table = chunking.chunk_rows(
        rows.filter(F.col("error").isNull()), "2024-01-01 00:00:00", "document_id", F.col("uri")
    )
    from paperloom import schemas

    assert [(f.name, f.dataType) for f in table.schema] == [
        (f.name, f.dataType) for f in schemas.CHUNK
    ]
    stored = table.collect()
    assert {row.document_id for row in stored} == {2, 3}
    for document, body in ((2, "a. " * 900), (3, "short")):
        own = sorted((r for r in stored if r.document_id == document), key=lambda r: r.chunk_index)
        assert [row.chunk_index for row in own] == list(range(len(own)))
        assert [row.chunk_text for row in own] == RecursiveSplitter()(body)
        assert all(row.chunk_size == len(row.chunk_text) for row in own)
        assert not any(row.processed_for_embedding for row in own)
    assert len({row.id for row in stored}) == len(stored)


def test_fixed_chunks_need_no_shuffle(spark, plan):
    frame = spark.createDataFrame([(1, "abc")], "document_id long, text string")
    assert "Exchange" not in plan(chunking.fixed_chunks(frame))


def test_report_moves_no_text(spark, plan, tmp_path):
    frame = spark.createDataFrame(
        [(1, 0, "abc"), (1, 1, "de"), (2, 0, "f")], "document_id long, chunk_index int, chunk_text string"
    )
    report = chunking.chunk_report(frame)
    assert sorted(tuple(row) for row in report.collect()) == [(1, 2, 5, 1), (2, 1, 1, 0)]
    assert "partial_count" in plan(report)


def test_chunker_in_sql(spark):
    body = "one. two. " * 200
    spark.createDataFrame([(1, body), (2, None)], "id long, text string").createOrReplaceTempView("texts")
    chunking.register_chunker(spark)
    rows = spark.sql(
        "SELECT id, chunk_index, chunk_text FROM texts, LATERAL recursive_chunks(text) ORDER BY chunk_index"
    ).collect()
    assert [(row.id, row.chunk_text) for row in rows] == [(1, c) for c in RecursiveSplitter()(body)]


def test_chunks_are_passed_on_in_bounded_batches():
    """What a task holds does not grow with the texts of a batch."""
    texts = ["word " * 400_000, None, "a b c", "tail"]
    batch = pa.RecordBatch.from_pydict({"id": [1, 2, 3, 4], "text": texts})
    names = ["id", "chunk_index", "chunk_text", "error"]
    splitter = RecursiveSplitter(size=1000, overlap=0)
    made = list(chunking._chunks_of(batch, ["id"], "text", splitter, names))
    assert len(made) > 1
    for one in made:
        size = sum(len(chunk or "") for chunk in one.column("chunk_text").to_pylist())
        assert size < chunking._CHARACTERS_PER_OUTPUT + 1000
    rows = pa.Table.from_batches(made).to_pylist()
    assert [row["chunk_text"] for row in rows if row["id"] == 1] == splitter(texts[0])
    assert [row["id"] for row in rows if row["error"]] == [2]
    assert [row["chunk_index"] for row in rows if row["id"] in (3, 4)] == [0, 0]


def test_windows_are_counted_by_length(spark):
    texts = [None, "", "a", "\n", *["x" * n for n in (199, 200, 201, 999, 1000, 1001, 1800, 1801, 5003)], "\U0001f600" * 1801]
    frame = spark.createDataFrame(list(enumerate(texts)), "document_id long, text string")
    assert chunking.fixed_count(frame) == chunking.fixed_chunks(frame).count()
    assert chunking.fixed_count(frame, 7, 3) == chunking.fixed_chunks(frame, 7, 3).count()
    assert chunking.fixed_count(frame.filter("false")) == 0
