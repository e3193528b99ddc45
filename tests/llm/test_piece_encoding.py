"""Piece encoding against the library."""

import hashlib
import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from paperloom.llm.piece_encoding import PieceTable, decode_pieces, encode_documents
from paperloom.llm.queries import op4_piece_encoding, tokenizer_file

FOLDER = "/root/testdata/sf0.001"
MODEL = tokenizer_file("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_texts_of_all_kinds_encode_as_the_library_does(library):
    draw = random.Random(1)
    table = PieceTable(MODEL)
    kinds = [
        list("abcth  e\n\t▁12.,é漢\x00\x1c😀İß　\r"),
        ["a", "aa", "aaa", " ", "b"],
        [library.id_to_piece(i).replace("▁", " ") for i in draw.choices(range(300, 32000), k=400)],
    ]
    for parts in kinds:
        for _ in range(1500):
            text = "".join(draw.choices(parts, k=draw.randrange(20)))
            assert table.encode(text).tolist() == library.encode(text)
    long = "".join(draw.choices("abcdefgh", k=20_000))
    assert table.encode(long).tolist() == library.encode(long)


def test_query(spark, library):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    frame = op4_piece_encoding(spark, FOLDER)
    assert frame.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    got = {r.doc_id: tuple(r)[1:] for r in frame.collect()}
    for doc_id, text in rows:
        ids = library.encode(text or "")
        assert got.pop(doc_id) == (
            len(ids),
            hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(library.decode(ids).encode()).hexdigest(),
        )
    assert not got


def test_edge_cases(spark, library):
    rows = [(1, None), (2, ""), (3, " "), (4, "same"), (4, "same"), (None, "x"), (5, "w " * 99_999)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "*", "1 as ids", "named_struct('decoded', 1) as other"
    )
    out = encode_documents(frame, MODEL)
    assert out.columns == ["doc_id", "text", "other", "ids", "decoded"]
    got = out.withColumn("again", decode_pieces(F.col("ids"), MODEL)).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = library.encode(r.text or "")
        assert list(r.ids) == ids and r.decoded == r.again == (library.decode(ids) if ids else "")
    assert encode_documents(frame.limit(0), MODEL).count() == 0
    assert encode_documents(frame, MODEL, decoded=None).columns == ["doc_id", "text", "other", "ids"]
