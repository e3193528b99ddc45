"""Token files: exact ids against the library, order, layout, selective reads."""

import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from paperloom.llm import token_store
from paperloom.llm.queries import op3_token_store, tokenizer_file
from paperloom.llm.token_store import SegmentEncoder

FOLDER = "/root/testdata/sf0.001"
FILE = tokenizer_file("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(FILE)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def test_segments_encode_as_the_whole(library, monkeypatch):
    draw = random.Random(2)
    parts = list("aBé漢1.,!'_-") + ["  ", " ", "\n", "\t", "\u00a0", "\x1c", "\x85", "'s", "😀",
                                   "<|endoftext|>", " word.", "Été,", "\r\n", "\x00"]
    encoder = SegmentEncoder(FILE)
    texts = ["".join(draw.choices(parts, k=draw.randrange(25))) for _ in range(3000)]
    texts += ["", "été.", "×. ÷, A.", "a.b. c,d", "Ö,\n", "x" * 300 + ". " + "y, " * 50, "."]
    for text in texts:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library(text)
    for kept in (1_000_000, 20):
        monkeypatch.setattr(token_store, "SEGMENTS_KEPT", kept)
        encoder = SegmentEncoder(FILE)
        for at in range(0, len(texts), 37):
            ids, sizes = encoder.encode_all(texts[at : at + 37])
            want = [library(text) for text in texts[at : at + 37]]
            assert sizes.tolist() == [len(x) for x in want]
            assert ids.tolist() == [i for x in want for i in x]
    assert library("<|endoftext|>") == [50256]


def test_query(spark, library):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    want, start = [], 0
    for doc_id, text in sorted(map(tuple, rows)):
        ids = [*library(text), 0]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    frame = op3_token_store(spark, FOLDER)
    assert frame.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, frame.collect())) == want


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_layout_and_selective_reads(spark, library, tmp_path, encoding, plan):
    rows = [(i, f"text number {i} " * (i % 7)) for i in range(3000)]
    random.Random(3).shuffle(rows)
    path = str(tmp_path / "tokens")
    token_store.write_tokens(
        spark.createDataFrame(rows, SCHEMA), path, FILE, encoding=encoding, part_chars=60_000,
        row_group_bytes=4096, page_bytes=1024, rows_per_page=50,
    )
    files = sorted((tmp_path / "tokens").glob("part-*.parquet"))
    assert len(files) > 1
    column = pq.ParquetFile(files[0]).metadata.row_group(0)
    ids = next(column.column(i) for i in range(column.num_columns) if "ids" in column.column(i).path_in_schema)
    assert ("RLE_DICTIONARY" in ids.encodings) == (encoding == "dictionary")
    assert ("DELTA_BINARY_PACKED" in ids.encodings) == (encoding == "delta")
    assert column.column(0).has_column_index and column.column(0).has_offset_index
    inside = [row for f in files for row in pq.read_table(f, columns=["doc_id"])["doc_id"].to_pylist()]
    assert inside == sorted(inside) or all(
        pq.read_table(f)["doc_id"].to_pylist() == sorted(pq.read_table(f)["doc_id"].to_pylist()) for f in files
    )
    some = token_store.read_tokens(spark, path, 100, 104)
    assert "PushedFilters" in plan(some) and "GreaterThanOrEqual(doc_id,100)" in plan(some)
    texts = dict(rows)
    assert {r.doc_id: list(r.ids) for r in some.collect()} == {
        i: [*library(texts[i]), 0] for i in range(100, 105)
    }
    metadata = token_store.read_metadata(spark, path)
    assert "ids" not in plan(metadata).split("ReadSchema")[1].split("\n")[0]
    start = 0
    for r in sorted(metadata.collect(), key=lambda r: r.doc_id):
        assert r.start == start
        start += r.n_tokens


def test_edge_cases(spark, library, tmp_path):
    rows = [(2, None), (1, ""), (None, "n"), (3, "b"), (3, "a"), (3, "a"), (4, "word " * 60_000)]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as part", "2 as ids")
    path = str(tmp_path / "edge")
    token_store.write_tokens(frame, path, FILE, part_chars=100)
    got = token_store.read_documents(spark, path).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens) for r in got) == sorted(
        (i is not None, i or 0, len(library(t)) + 1) for i, t in rows
    )
    assert sorted(r.start for r in got)[0] == next(r.start for r in got if r.doc_id is None) == 0
    empty = str(tmp_path / "empty")
    token_store.write_tokens(frame.limit(0), empty, FILE)
    assert token_store.read_documents(spark, empty).count() == 0
    with pytest.raises(ValueError):
        token_store.write_tokens(frame, empty, FILE, encoding="plain")
