"""Search over quantised vectors against the search that compares everything."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_oracle import FOLDER
from test_retrieval import as_ranks, brute_force, chunk_frame, question_frame

import __spark_entry__ as entry
from paperloom.operators import quantised, retrieval
from paperloom.plans import index_flow


@pytest.fixture(scope="module")
def vectors():
    """Directions around few middles, among them copies, zero vectors and whole numbers."""
    draw = np.random.default_rng(3)
    middles = draw.normal(size=(6, 10))
    chunks = middles[draw.integers(0, 6, 900)] + draw.normal(0, 0.3, (900, 10))
    chunks[100:300] = chunks[100]
    chunks[300:400] = draw.integers(-2, 3, (100, 10))
    chunks[400:405] = 0
    questions = np.vstack([middles, draw.integers(-2, 3, (12, 10)), chunks[100:101], np.zeros((1, 10))])
    return questions.astype(np.float32).astype(float), chunks.astype(np.float32).astype(float)


@pytest.fixture(scope="module")
def stored(spark, vectors, tmp_path_factory):
    store = str(tmp_path_factory.mktemp("codes"))
    index_flow.build_quantised_index(chunk_frame(spark, vectors[1]), store, cells=8, sample=300)
    return store


@pytest.mark.parametrize("k", [1, 3, 50])
@pytest.mark.parametrize("question_bytes", [2**20, 500])
def test_search_by_bounds_is_exact(spark, vectors, stored, k, question_bytes):
    questions, chunks = vectors
    index, fitted = index_flow.quantised_index(spark, stored)
    found = quantised.exact_top_k(
        question_frame(spark, questions), index, fitted, k, question_bytes=question_bytes
    )
    assert as_ranks(found) == brute_force(questions, chunks, k)


def test_bounds_leave_out_most_vectors(spark, vectors, stored):
    questions, chunks = vectors
    index, fitted = index_flow.quantised_index(spark, stored)
    asked = question_frame(spark, questions[:6])
    counts = quantised.compared(asked, index, fitted).collect()
    usable = int((chunks != 0).any(axis=1).sum())
    assert sum(r.looked_up for r in counts) <= 0.6 * 6 * usable
    assert sum(r.compared for r in counts) <= 0.1 * 6 * usable


def test_codes_keep_to_their_bounds(spark, vectors, stored):
    _, chunks = vectors
    index, fitted = index_flow.quantised_index(spark, stored)
    rows = index.collect()
    assert len(rows) == int((chunks != 0).any(axis=1).sum())
    for r in rows:
        unit = np.array(r.embedding) / np.linalg.norm(r.embedding)
        codes = np.frombuffer(r.codes, np.uint8)[None]
        about = fitted.directions(np.array([r.cell]), codes)[0]
        assert abs(np.linalg.norm(unit - about) - r.error) < 1e-9
        assert abs(math.cos(r.angle) - unit @ fitted.centres[r.cell]) < 1e-9
        assert len(r.codes) == 5


def test_approximate_search_compares_the_kept_exactly(spark, vectors, stored):
    questions, chunks = vectors
    asked = question_frame(spark, questions)
    exact = brute_force(questions, chunks, 3)
    whole = as_ranks(index_flow.search_quantised(asked, stored, 8, keep=900))
    assert whole == exact
    some = as_ranks(index_flow.search_quantised(asked, stored, 3, keep=60))
    truth = {}
    for (q, _), (document, chunk, score) in brute_force(questions, chunks, 900).items():
        truth[q, document, chunk] = score
    assert all(truth[q, d, c] == score for (q, _), (d, c, score) in some.items())
    around = [key for key in exact if key[0] < 6]
    hits = sum(some.get(key, (0, 0, 0))[2] == exact[key][2] for key in around)
    assert hits >= 0.9 * len(around)


def test_cells_without_questions_are_not_read(spark, vectors, stored, plan):
    questions, _ = vectors
    index, fitted = index_flow.quantised_index(spark, stored)
    asked = question_frame(spark, questions[:1])
    near = quantised._near_codes(asked, index, fitted, 1, 5)
    text = plan(near)
    scan = text[text.index("Scan parquet") :]
    assert "PartitionFilters: [isnotnull(cell" in scan or "PartitionFilters: [cell" in scan
    assert "codes:binary" in scan and "embedding" not in scan.split("ReadSchema")[1].split("\n")[0]


def test_odd_inputs(spark, vectors, stored):
    questions, _ = vectors
    schema = "document_id long, chunk_index int, embedding array<float>"
    chunks = spark.createDataFrame(
        [(1, 0, [1.0, 2.0, 3.0]), (1, 1, None), (2, 0, [0.0, 0.0, 0.0]), (3, 0, [3.0, 2.0, 1.0]), (3, 0, [3.0, 2.0, 1.0])],
        schema,
    )
    fitted = quantised.train(chunks, 5)
    index = quantised.encode(chunks.withColumn("cell", F.lit("x")), fitted)
    assert index.count() == 3
    asked = spark.createDataFrame([("a", [1.0, 2.0, 3.0]), ("b", None), ("c", [0.0] * 3)], "query_id string, embedding array<float>")
    for found in (quantised.exact_top_k(asked, index, fitted, 9), quantised.approximate_top_k(asked, index, fitted, 9, 9)):
        got = [(r.query_id, r["rank"], r.document_id) for r in found.collect()]
        assert sorted(got) == [("a", 1, 1), ("a", 2, 3), ("a", 3, 3)]
    assert quantised.exact_top_k(asked.limit(0), index, fitted).count() == 0
    assert quantised.approximate_top_k(asked, index.limit(0), fitted, 2).count() == 0
    assert quantised.exact_top_k(asked, index.limit(0), fitted).count() == 0
    with pytest.raises(ValueError):
        quantised.train(chunks.limit(0), 2)


def test_recall_on_the_given_vectors(spark):
    def others(name):
        rows = entry.queries()[name](spark, FOLDER).collect()
        return {(r.query_id, r.document_id) for r in rows if r.query_id != r.document_id}

    exact = others("vector_topk")
    assert len(exact & others("vector_topk_quantised")) >= 0.9 * len(exact)


def test_few_vectors_are_compared_on_the_given_ones(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    chunks = rows.select(
        F.col("vec_id").alias("document_id"), F.col("label").alias("chunk_index"), "embedding"
    )
    fitted = quantised.train(chunks, 32)
    index = quantised.encode(chunks, fitted)
    asked = rows.select(F.col("vec_id").alias("query_id"), "embedding")
    total = index.count()
    share = quantised.compared(asked, index, fitted).agg(F.avg("compared")).first()[0] / total
    assert share <= 0.25
    assert retrieval.top_k_chunks(asked, chunks).count() == 3 * total


def test_many_questions_are_not_on_the_driver(spark, vectors, stored, plan, monkeypatch):
    questions, chunks = vectors
    index, fitted = index_flow.quantised_index(spark, stored)
    asked = question_frame(spark, questions)
    monkeypatch.setattr(quantised, "CODES_PER_CELL", 300)
    found = quantised.exact_top_k(asked, index, fitted, question_bytes=500)
    # Once for the floors and once for the search; no questions sent by the driver.
    assert plan(found).count("FlatMapCoGroupsInArrow (") >= 2 and "MapInArrow (" not in plan(found)
    monkeypatch.setattr(quantised, "KEPT_ROWS", 40)
    near = quantised._near_codes(asked, index, fitted, 3, 5)
    assert "FlatMapCoGroupsInArrow" in plan(near)
