import re

import pytest
from pyspark.sql import functions as F

from paperloom import schemas
from paperloom.operators import documents, ingest
from paperloom.operators.chunking import RecursiveSplitter
from paperloom.plans import ingest_flow
from paperloom.plans.ingest_flow import ingest_batch
from paperloom.sources import tables
from paperloom.sources.landing import landing_files
from paperloom.streaming.embed_stream import EMBEDDED, EMBEDDING_TABLE, embed_batch, start_embedding
from paperloom.operators.embedding import HashedEmbedder
from paperloom.streaming.ingest_stream import start_ingest

UUID = "123e4567-e89b-12d3-a456-426614174000"
GOOD = {
    f"{UUID}.pdf": "page one\fpage two " + "word. " * 400,
    f"sub/dir/{UUID.upper()}.PDF": "other text",
    "sub/plain.pdf": "no uuid here",
    "sub/blank.pdf": " \f ",
}
BROKEN = "sub/broken.pdf"
NOW = "2024-05-01 12:00:00"


def put(folder, name, content):
    target = folder / name
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_bytes(content if isinstance(content, bytes) else content.encode())


@pytest.fixture
def landing(tmp_path):
    folder = tmp_path / "landing"
    (folder / "empty").mkdir(parents=True)
    for name, text in GOOD.items():
        put(folder, name, text)
    put(folder, BROKEN, b"bad \xff byte")
    put(folder, "sub/note.txt", "not a pdf")
    return folder


def table(spark, store, name, schema):
    if name == "document":
        return tables.read_documents(spark, str(store))
    return tables.read_table(spark, str(store), name, schema)


def test_scan_finds_pdfs_at_any_depth(spark, landing, plan):
    found = landing_files(spark, str(landing))
    names = {row.path.split("/landing/")[1] for row in found.select("path").collect()}
    assert names == {*GOOD, BROKEN}
    assert "content" not in plan(found.select("path", "length").filter("length > 5")).split("ReadSchema")[1]


def test_decode_and_rows(spark, landing, plan):
    decoded = ingest.decode_files(landing_files(spark, str(landing)))
    rows = ingest.document_rows(decoded, NOW)
    assert "Exchange" not in plan(rows)
    assert [(f.name, f.dataType) for f in rows.schema] == [(f.name, f.dataType) for f in schemas.DOCUMENT]
    found = {row.file_path.split("/landing/")[1]: row for row in rows.collect()}
    assert set(found) == set(GOOD)
    for name, content in GOOD.items():
        row = found[name]
        text = content.replace("\f", "")
        assert (row.text, row.page_count) == (text, content.count("\f") + 1)
        assert row.word_count == len(text.split())
        assert row.file_name == name.rsplit("/", 1)[-1]
        assert row.upload_timestamp == row.created_at
        assert (row.expires_at - row.created_at).total_seconds() == 24 * 3600
    assert found[f"{UUID}.pdf"].document_uuid == UUID
    assert found[f"sub/dir/{UUID.upper()}.PDF"].document_uuid == UUID.upper()
    errors = ingest.error_rows(decoded, NOW).collect()
    assert [row.file_path.split("/landing/")[1] for row in errors] == [BROKEN]
    assert errors[0].error_message.startswith("Failed to extract text from PDF: 'utf-8' codec")
    assert "UnicodeDecodeError" in errors[0].stack_trace


def test_assemble_pages_in_any_order(spark):
    pages = [("a", 2, "C"), ("a", 0, "A"), ("a", 1, ""), ("b", 0, "x"), ("a", 10, "E"), ("a", 9, "D")]
    frame = spark.createDataFrame(pages, "path string, page_no int, page_text string")
    found = {row.path: (row.page_count, row.text) for row in ingest.assemble_pages(frame).collect()}
    assert found == {"a": (5, "ACDE"), "b": (1, "x")}


def test_page_rows_and_back(spark, landing):
    decoded = ingest.decode_files(landing_files(spark, str(landing)))
    whole = {r.file_path: (r.page_count, r.text) for r in ingest.document_rows(decoded, NOW).collect()}
    parts = ingest.assemble_pages(ingest.page_rows(decoded))
    assert {r.path: (r.page_count, r.text) for r in parts.collect()} == whole


def snapshot(spark, store):
    def rows(name, schema):
        return sorted(map(str, table(spark, store, name, schema).collect()))

    return (
        rows("document", schemas.DOCUMENT),
        rows("document_chunks_staging", schemas.CHUNK),
        rows("document_processing_error", schemas.PROCESSING_ERROR),
    )


def test_batch_and_its_replay(spark, landing, tmp_path):
    store = tmp_path / "store"
    files = landing_files(spark, str(landing))
    ingest_batch(files, str(store), 0, NOW)
    first = snapshot(spark, store)
    assert [len(part) for part in first[::2]] == [4, 1]
    stored = table(spark, store, "document", schemas.DOCUMENT)
    chunks = table(spark, store, "document_chunks_staging", schemas.CHUNK)
    expected = {r.id: RecursiveSplitter()(r.text) for r in stored.collect()}
    for identity, texts in expected.items():
        own = chunks.filter(F.col("document_id") == identity).orderBy("chunk_index").collect()
        assert [row.chunk_text for row in own] == texts
    assert documents.orphan_chunks(chunks, stored).isEmpty()
    assert documents.unchunked_documents(stored, chunks).select("file_name").collect()[0][0] == "blank.pdf"
    assert documents.duplicate_keys(stored, "id").isEmpty()
    assert documents.duplicate_keys(chunks, "id").isEmpty()
    ingest_batch(files, str(store), 0, NOW)
    assert snapshot(spark, store) == first
    finished = spark.createDataFrame([], ingest_flow.FINISHED).schema
    report = table(spark, store, ingest_flow.BATCH_TABLE, finished).collect()
    assert [(r.files, r.documents, r.chunks, r.errors) for r in report] == [(5, 4, len(first[1]), 1)]
    assert report[0].seconds > 0


def test_stored_tables_are_there_for_sql(spark, landing, tmp_path):
    store = str(tmp_path / "store")
    spark.sql("CREATE DATABASE IF NOT EXISTS ingested")
    for batch in range(2):
        ingest_batch(landing_files(spark, str(landing)), store, batch, NOW)
        schemas.open_store(spark, store, "ingested")
        assert spark.table("ingested.document").count() == 4 * (batch + 1)
    latest = spark.sql(
        "SELECT id FROM ingested.document WHERE document_uuid = :uuid ORDER BY created_at DESC LIMIT 1",
        args={"uuid": UUID},
    ).collect()
    chunks = spark.table("ingested.document_chunks_staging").filter("batch_id = 1")
    assert chunks.filter(F.col("document_id") == latest[0].id).count() > 1
    assert spark.table("ingested.document_processing_error").count() == 2


def test_replay_that_goes_better_leaves_no_error_behind(spark, landing, tmp_path):
    store = tmp_path / "store"
    files = landing_files(spark, str(landing))
    ingest_batch(files, str(store), 3, NOW)
    ingest_batch(files, str(store), 3, NOW, decoder=lambda content: [content.decode("latin-1")])
    assert table(spark, store, "document_processing_error", schemas.PROCESSING_ERROR).isEmpty()
    assert table(spark, store, "document", schemas.DOCUMENT).count() == 5


def test_failing_splitter_becomes_an_error_row(spark, landing, tmp_path):
    def splitter(text):
        if "other" in text:
            raise RuntimeError("cannot cut")
        return [text]

    store = tmp_path / "store"
    ingest_batch(landing_files(spark, str(landing)), str(store), 0, NOW, splitter=splitter)
    errors = table(spark, store, "document_processing_error", schemas.PROCESSING_ERROR).collect()
    messages = sorted(row.error_message for row in errors)
    assert len(messages) == 2
    assert re.fullmatch(r"Failed to chunk document -?\d+: cannot cut", messages[0])
    assert "RuntimeError" in [r for r in errors if "chunk" in r.error_message][0].stack_trace
    assert table(spark, store, "document", schemas.DOCUMENT).count() == 4
    assert table(spark, store, "document_chunks_staging", schemas.CHUNK).select("document_id").distinct().count() == 3


def test_dispositions_do_not_clash(spark, tmp_path):
    store, first, second = tmp_path / "store", tmp_path / "one", tmp_path / "two"
    put(first, "a/x.pdf", "one")
    put(first, "b/x.pdf", "two")
    put(first, "c/x.pdf", b"\xff")
    put(second, "x.pdf", "three")
    ingest_batch(landing_files(spark, str(first)), str(store), 0, NOW)
    ingest_batch(landing_files(spark, str(second)), str(store), 1, NOW)
    schema = spark.createDataFrame([], ingest_flow.DISPOSITION).schema
    rows = table(spark, store, ingest_flow.DISPOSITION_TABLE, schema).collect()
    assert sorted(row.archived_path for row in rows) == [
        "errors/x.pdf", "processed/x.pdf", "processed/x_1.pdf", "processed/x_2.pdf",
    ]
    assert {row.outcome for row in rows if row.archived_path.startswith("errors")} == {"error"}


def test_empty_batch_is_finished_with_nothing(spark, tmp_path):
    store = tmp_path / "store"
    ingest_batch(spark.createDataFrame([], schemas.LANDING_FILES), str(store), 0, NOW)
    finished = spark.createDataFrame([], ingest_flow.FINISHED).schema
    report = table(spark, store, ingest_flow.BATCH_TABLE, finished).collect()
    assert [(r.files, r.documents, r.chunks, r.errors) for r in report] == [(0, 0, 0, 0)]
    assert snapshot(spark, store) == ([], [], [])


def test_unfinished_batch_is_not_seen(spark, landing, tmp_path):
    store = tmp_path / "store"
    ingest_batch(landing_files(spark, str(landing)), str(store), 0, NOW)
    def finished():
        return ingest_flow.finished_rows(spark, str(store), table(spark, store, "document", None)).count()

    assert finished() == 4
    halfway = tables.read_table(spark, str(store), schemas.FILE_TABLE, schemas.FILE).drop("batch_id")
    tables.write_batch(halfway, str(store), schemas.FILE_TABLE, 1, within=["outcome"])
    assert table(spark, store, "document", None).count() == 8
    assert finished() == 4


def run(query):
    assert query.awaitTermination(120)
    assert query.exception() is None


def test_stream_takes_each_file_once(spark, landing, tmp_path):
    store, checkpoint = tmp_path / "store", str(tmp_path / "checkpoint")
    start = lambda: run(start_ingest(spark, str(landing), str(store), checkpoint, files_per_batch=2, clock=lambda: NOW))
    start()
    first = snapshot(spark, store)
    assert [len(part) for part in first[::2]] == [4, 1]
    start()
    assert snapshot(spark, store) == first
    put(landing, "late/new.pdf", "came later")
    start()
    names = [r[0] for r in table(spark, store, "document", schemas.DOCUMENT).select("file_name").collect()]
    assert sorted(names) == sorted([*[name.rsplit("/", 1)[-1] for name in GOOD], "new.pdf"])


def test_embedding_stream_follows_chunks(spark, landing, tmp_path):
    store = tmp_path / "store"
    ingested, embedded = str(tmp_path / "c1"), str(tmp_path / "c2")
    run(start_ingest(spark, str(landing), str(store), ingested, clock=lambda: NOW))
    run(start_embedding(spark, str(store), embedded))
    keys = ["document_id", "chunk_index"]
    chunks = table(spark, store, "document_chunks_staging", schemas.CHUNK)
    vectors = table(spark, store, EMBEDDING_TABLE, EMBEDDED)
    assert sorted(vectors.select(*keys).collect()) == sorted(chunks.select(*keys).collect())
    assert documents.pending_chunks(chunks, vectors).isEmpty()

    put(landing, "late/new.pdf", "came later")
    run(start_ingest(spark, str(landing), str(store), ingested, clock=lambda: NOW))
    run(start_embedding(spark, str(store), embedded))
    # A replayed ingest batch writes its files anew; nothing is embedded twice.
    ingest_batch(landing_files(spark, str(landing)).filter(~F.col("path").contains("late")), str(store), 0, NOW)
    run(start_embedding(spark, str(store), embedded))
    chunks = table(spark, store, "document_chunks_staging", schemas.CHUNK)
    vectors = table(spark, store, EMBEDDING_TABLE, EMBEDDED)
    assert sorted(vectors.select(*keys).collect()) == sorted(chunks.select(*keys).collect())
    # So does a replayed embedding batch.
    embed_batch(chunks.filter("batch_id = 0"), str(store), 0, HashedEmbedder())
    assert table(spark, store, EMBEDDING_TABLE, EMBEDDED).count() == chunks.count()
