import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paperloom.operators import embedding, retrieval
from paperloom.operators.embedding import HashedEmbedder

WIDTH = 8


@pytest.fixture(scope="module")
def vectors():
    """Small whole numbers give many equal scores; copies and zero vectors among them."""
    draw = np.random.default_rng(11)
    chunks = draw.integers(-2, 3, (400, WIDTH)).astype(float)
    chunks[50:180] = chunks[50]
    chunks[200:205] = 0
    questions = np.vstack([draw.integers(-2, 3, (17, WIDTH)), chunks[50:51], np.zeros((1, WIDTH))])
    return questions.astype(float), chunks


def question_frame(spark, matrix):
    rows = [(i, row.tolist()) for i, row in enumerate(matrix)]
    return spark.createDataFrame(rows, "query_id long, embedding array<float>")


def chunk_frame(spark, matrix):
    rows = [(i // 3, i % 3, row.tolist(), f"text {i}") for i, row in enumerate(matrix)]
    schema = "document_id long, chunk_index int, embedding array<float>, chunk_text string"
    return spark.createDataFrame(rows, schema).repartition(5)


def brute_force(questions, chunks, k, min_score=-math.inf):
    expected = {}
    for q, question in enumerate(questions):
        scored = []
        for c, chunk in enumerate(chunks):
            length = math.sqrt((question @ question) * (chunk @ chunk))
            if length and (score := round((question @ chunk) / length, 12)) > min_score:
                scored.append((-score, c // 3, c % 3))
        for rank, (score, document, index) in enumerate(sorted(scored)[:k], 1):
            expected[q, rank] = (document, index, pytest.approx(-score))
    return expected


def as_ranks(ranked):
    return {(r.query_id, r["rank"]): (r.document_id, r.chunk_index, r.score) for r in ranked.collect()}


@pytest.mark.parametrize("k", [1, 3, 500])
@pytest.mark.parametrize("min_score", [None, 0.0, 0.9])
def test_exact_top_k(spark, vectors, k, min_score):
    questions, chunks = vectors
    ranked = retrieval.top_k_chunks(
        question_frame(spark, questions), chunk_frame(spark, chunks), k, min_score
    )
    assert as_ranks(ranked) == brute_force(questions, chunks, k, -math.inf if min_score is None else min_score)


def test_small_blocks_give_the_same(spark, vectors, monkeypatch):
    monkeypatch.setattr(retrieval, "_SCORES_PER_BLOCK", 200)
    monkeypatch.setattr(retrieval, "_QUESTIONS_PER_BLOCK", 7)
    questions, chunks = vectors
    ranked = retrieval.top_k_chunks(question_frame(spark, questions), chunk_frame(spark, chunks))
    assert as_ranks(ranked) == brute_force(questions, chunks, 3)


def test_questions_too_many_to_send(spark, vectors, plan, monkeypatch):
    monkeypatch.setattr(retrieval, "CHUNKS_PER_CELL", 60)
    questions, chunks = vectors
    ranked = retrieval.top_k_chunks(
        question_frame(spark, questions),
        chunk_frame(spark, chunks),
        carry=("chunk_text",),
        question_bytes=5 * 8 * WIDTH,
    )
    assert "FlatMapCoGroupsInArrow" in plan(ranked)
    assert as_ranks(ranked) == brute_force(questions, chunks, 3)
    assert all(
        row.chunk_text == f"text {row.document_id * 3 + row.chunk_index}" for row in ranked.collect()
    )


def test_grid_embeds_texts_on_the_way(spark):
    texts = [(i, 0, f"word{i % 7} common") for i in range(30)]
    chunks = spark.createDataFrame(texts, "document_id long, chunk_index int, chunk_text string")
    asked = spark.createDataFrame([(i, f"word{i}") for i in range(9)], "query_id long, query string")
    questions = embedding.embed(asked, "query", HashedEmbedder(16))

    def ranks(limit):
        return as_ranks(retrieval.top_k_chunks(
            questions, chunks, min_score=0.0, embedder=HashedEmbedder(16), question_bytes=limit
        ))

    assert ranks(10_000) == ranks(128)
    assert {key[0] for key in ranks(10_000)} >= set(range(7))


def test_ranking_is_dense_and_limits_before_the_shuffle(spark, vectors, plan):
    questions, chunks = vectors
    ranked = retrieval.top_k_chunks(question_frame(spark, questions), chunk_frame(spark, chunks))
    before_shuffle = plan(ranked)
    assert before_shuffle.count("WindowGroupLimit") >= 2 and "CartesianProduct" not in before_shuffle
    assert "NestedLoop" not in before_shuffle
    ranks = {}
    for question, rank in as_ranks(ranked):
        ranks.setdefault(question, []).append(rank)
    assert all(sorted(own) == [1, 2, 3] for own in ranks.values())


def test_empty_inputs(spark, vectors):
    questions, chunks = vectors
    none = question_frame(spark, questions).filter("false")
    assert retrieval.top_k_chunks(none, chunk_frame(spark, chunks)).count() == 0
    nothing = chunk_frame(spark, chunks).filter("false")
    assert retrieval.top_k_chunks(question_frame(spark, questions), nothing).count() == 0
    missing = chunk_frame(spark, chunks).withColumn("embedding", F.lit(None).cast("array<float>"))
    assert retrieval.top_k_chunks(question_frame(spark, questions), missing).count() == 0


def test_unequal_vectors_are_refused(spark, vectors):
    questions, _ = vectors
    odd = spark.createDataFrame(
        [(1, 0, [1.0, 2.0]), (2, 0, [1.0])], "document_id long, chunk_index int, embedding array<float>"
    ).coalesce(1)
    with pytest.raises(Exception, match="vectors must all have"):
        retrieval.top_k_chunks(question_frame(spark, questions), odd).collect()


@pytest.fixture(scope="module")
def clusters():
    draw = np.random.default_rng(2)
    centres = draw.standard_normal((12, 32))
    chunks = np.vstack([centre + 0.4 * draw.standard_normal((60, 32)) for centre in centres])
    return chunks[::15] + 0.1 * draw.standard_normal((len(chunks[::15]), 32)), chunks


def test_approximate_recall(spark, clusters):
    questions, chunks = clusters
    centres = retrieval.train_cells(chunk_frame(spark, chunks), 16)
    assert centres.shape == (16, 32)
    cells = retrieval.assign_cells(chunk_frame(spark, chunks), centres)
    exact = as_ranks(retrieval.top_k_chunks(question_frame(spark, questions), chunk_frame(spark, chunks)))
    pairs = {(key[0], *hit[:2]) for key, hit in exact.items()}

    def found(probes, **options):
        ranked = retrieval.approximate_top_k(
            question_frame(spark, questions), cells, centres, probes, **options
        )
        return as_ranks(ranked)

    near = {(key[0], *hit[:2]) for key, hit in found(3).items()}
    assert len(pairs & near) / len(pairs) > 0.9
    assert {(key[0], *hit[:2]) for key, hit in found(16).items()} == pairs
    assert found(3, question_bytes=10 * 8 * 32, chunks_per_block=25) == found(3)


def test_blocks_of_a_cell_are_bounded_in_bytes(spark, monkeypatch):
    """Wide vectors: chunks and questions that meet stay within the bytes given."""
    matrix = np.random.default_rng(3).normal(size=(600, 64))
    questions, chunks = question_frame(spark, matrix[:90]), chunk_frame(spark, matrix)
    centres = matrix[:2]
    sizes = []
    meet = retrieval._Ranker.cell_candidates

    def recorded(self, left, right, keys, cells):
        sizes.extend(left.groupBy(*keys).count().collect())
        return meet(self, left, right, keys, cells)

    monkeypatch.setattr(retrieval._Ranker, "cell_candidates", recorded)
    cells = retrieval.assign_cells(chunks, centres)
    found = retrieval.approximate_top_k(questions, cells, centres, 2, question_bytes=16 * 1024)
    # 64 chunks take 16 KB; they are dealt by hash.
    assert max(row["count"] for row in sizes) <= 2 * 64
    exact = retrieval.top_k_chunks(questions, chunks)
    assert as_ranks(found) == as_ranks(exact)


def test_probed_cells_prune_stored_partitions(spark, clusters, plan, tmp_path):
    questions, chunks = clusters
    cells = retrieval.assign_cells(chunk_frame(spark, chunks), chunks[::100])
    cells.write.partitionBy("cell").parquet(str(tmp_path / "cells"))
    stored = spark.read.parquet(str(tmp_path / "cells"))
    ranked = retrieval.approximate_top_k(question_frame(spark, questions[:1]), stored, chunks[::100], 2)
    scan = plan(ranked)
    assert "PartitionFilters: [cell" in scan.replace("isnotnull(cell", "cell")
    assert "chunk_text" not in scan.split("ReadSchema")[1].split("\n")[0]
    assert ranked.count() == 3


def test_nearest_cells(monkeypatch):
    draw = np.random.default_rng(0)
    points, centres = draw.standard_normal((20, 16)), draw.standard_normal((8, 16))
    cosines = points @ centres.T / np.linalg.norm(centres, axis=1)
    expected = np.argsort(-cosines, axis=1)
    assert (retrieval.nearest_cells(points, centres, 3) == expected[:, :3]).all()
    monkeypatch.setattr(retrieval, "_SCORES_PER_BLOCK", 24)
    assert (retrieval.nearest_cells(points, centres, 99) == expected).all()


def test_centres_are_checked_before_they_are_sent(spark, clusters, monkeypatch):
    _, chunks = clusters
    monkeypatch.setattr(retrieval, "CENTRE_BYTES", 1000)
    with pytest.raises(ValueError, match="centres take"):
        retrieval.assign_cells(chunk_frame(spark, chunks), chunks[:10])


def test_no_text_in_the_ranking(spark, vectors, plan, tmp_path):
    questions, chunks = vectors
    chunk_frame(spark, chunks).write.parquet(str(tmp_path / "chunks"))
    stored = spark.read.parquet(str(tmp_path / "chunks"))
    for limit in (10_000_000, 5 * 8 * WIDTH):
        ranked = retrieval.top_k_chunks(question_frame(spark, questions), stored, question_bytes=limit)
        assert "Exchange" in plan(ranked) and "chunk_text" not in plan(ranked)


def test_hashed_embedder():
    embedder = HashedEmbedder(32)
    matrix = embedder(["Alpha beta, ALPHA!", "", None, "beta alpha alpha"])
    assert matrix.sum(axis=1).tolist() == [3, 0, 0, 3]
    assert (matrix[0] == matrix[3]).all()


def test_pluggable_embedder(spark):
    frame = spark.createDataFrame([(1, "a"), (2, "bbb")], "id long, t string")
    rows = embedding.embed(frame, "t", lambda texts: np.array([[len(t), 1.0] for t in texts])).collect()
    assert sorted((row.id, row.embedding) for row in rows) == [(1, [1.0, 1.0]), (2, [3.0, 1.0])]


def test_contexts_and_excerpts(spark):
    questions = spark.createDataFrame([(1, "q1"), (2, "q2")], "query_id long, query string")
    ranked = spark.createDataFrame(
        [(1, 2, 7, 0, "second"), (1, 10, 7, 4, "last"), (1, 1, 8, 3, "first")],
        "query_id long, rank int, document_id long, chunk_index long, chunk_text string",
    )
    found = {r.query_id: r.context for r in retrieval.contexts(questions, ranked).collect()}
    assert found == {1: "first\n\nsecond\n\nlast", 2: ""}
    cited = {r.query_id: r.excerpts for r in retrieval.excerpts(questions, ranked, "none").collect()}
    assert cited == {1: "[8#3] first\n\n[7#0] second\n\n[7#4] last", 2: "none"}


def test_texts_join_the_result(spark, vectors):
    questions, chunks = vectors
    frame = chunk_frame(spark, chunks)
    ranked = retrieval.top_k_chunks(question_frame(spark, questions), frame)
    joined = retrieval.with_chunk_text(ranked, frame).collect()
    assert len(joined) == ranked.count()
    assert all(row.chunk_text == f"text {row.document_id * 3 + row.chunk_index}" for row in joined)


def test_stored_index(spark, clusters, plan, tmp_path):
    from paperloom.plans import index_flow

    questions, chunks = clusters
    frame = chunk_frame(spark, chunks)
    index_flow.build_index(frame, str(tmp_path), 16)
    asked = question_frame(spark, questions)
    exact = as_ranks(retrieval.top_k_chunks(asked, frame))
    assert as_ranks(index_flow.search_index(asked, str(tmp_path), 16)) == exact
    one = index_flow.search_index(asked.limit(1), str(tmp_path), 2)
    assert "PartitionFilters: [cell" in plan(one).replace("isnotnull(cell", "cell")
    assert one.count() == 3


def test_question_ids_of_any_type(spark, vectors):
    questions, chunks = vectors
    named = question_frame(spark, questions).withColumn("query_id", F.concat(F.lit("q"), "query_id"))
    expected = {(f"q{q}", rank): hit for (q, rank), hit in brute_force(questions, chunks, 3).items()}
    for limit in (10_000, 5 * 8 * WIDTH):
        ranked = retrieval.top_k_chunks(named, chunk_frame(spark, chunks), question_bytes=limit)
        assert as_ranks(ranked) == expected


def test_grids_of_few_bytes_have_cells_for_all_cores(spark, vectors, monkeypatch):
    """A task has few cells, and a cell bounded work: small vectors were one long task."""
    questions, chunks = vectors
    asked, held = question_frame(spark, questions), chunk_frame(spark, chunks)
    monkeypatch.setattr(retrieval, "PAIRS_PER_CELL", 100)
    ranked = retrieval.top_k_chunks(asked, held, question_bytes=len(questions) * 8 * WIDTH - 1)
    assert as_ranks(ranked) == brute_force(questions, chunks, 3)
    cores = spark.sparkContext.defaultParallelism
    ranker = retrieval._Ranker(asked, held, 3, None, None, ())
    for count, stored, columns in ((100_000, 100_000, 1), (600_000, 600_000, 5), (200_000, 6_000_000, 7)):
        monkeypatch.setattr(retrieval, "PAIRS_PER_CELL", 4_000_000_000)
        rows, wide = ranker._grid(count, stored, columns)
        assert wide >= columns and rows * wide >= 4 * cores
        assert count * stored / (rows * wide) <= retrieval.PAIRS_PER_CELL
        assert stored / rows <= retrieval.CHUNKS_PER_CELL
    rows = retrieval._Ranker(asked, held, 3, None, None, ()).cell_candidates(
        held.select("document_id", "chunk_index", "embedding", F.lit(0).alias("_row")),
        asked.select("query_id", "embedding", F.lit(0).alias("_row")),
        ["_row"],
        9,
    )
    assert rows.rdd.getNumPartitions() == 18


def test_single_precision_loses_no_pair(spark):
    """Scores that differ by less than single precision can tell keep their order."""
    draw = np.random.default_rng(8)
    base = draw.standard_normal(WIDTH).astype(np.float32).astype(float)
    chunks = np.tile(base, (300, 1))
    chunks[:, 0] *= 1 + np.arange(300) * 1e-6
    chunks = chunks[draw.permutation(300)].astype(np.float32).astype(float)
    questions = np.vstack([base, -base, base * 1e3])
    for limit in (10_000, 3 * 8 * WIDTH - 1):
        ranked = retrieval.top_k_chunks(
            question_frame(spark, questions), chunk_frame(spark, chunks), question_bytes=limit
        )
        assert as_ranks(ranked) == brute_force(questions, chunks, 3)


def test_places_of_few_hits():
    draw = np.random.default_rng(4)
    for shape in ((1, 1), (3, 7), (5, 16), (9, 31)):
        for share in (0, 0.05, 1):
            hit = draw.random(shape) < share
            assert retrieval._places(hit).tolist() == np.flatnonzero(hit).tolist()


def test_chunks_are_not_made_to_be_counted(spark, vectors, monkeypatch):
    """Where the number of chunks is given, the grid does not make them once more."""
    from pyspark.sql.classic.dataframe import DataFrame

    questions, chunks = vectors
    asked, held = question_frame(spark, questions), chunk_frame(spark, chunks)
    counted = []
    count = DataFrame.count
    monkeypatch.setattr(DataFrame, "count", lambda own: counted.append(own.columns) or count(own))
    limit = {"question_bytes": 5 * 8 * WIDTH}
    given = retrieval.top_k_chunks(asked, held, held=lambda: len(chunks), **limit)
    assert held.columns not in counted
    assert as_ranks(given) == brute_force(questions, chunks, 3)
    # A number that is far off gives other cells, and the same rows.
    off = retrieval.top_k_chunks(asked, held, held=lambda: 3, **limit)
    assert as_ranks(off) == as_ranks(given)


@pytest.mark.parametrize("k, min_score", [(1, None), (3, None), (3, 0.0), (3, 0.9), (40, None)])
def test_counts_are_compared_several_at_a_time(spark, monkeypatch, k, min_score):
    """Vectors of counts have whole products: three share a number where lengths allow it.
    Copies, zeros, and products above 2 ** 8 and 2 ** 16 give the same rows."""
    draw = np.random.default_rng(5)
    chunks = draw.integers(0, 4, (900, 16)) * (draw.random((900, 16)) < 0.4)
    chunks[100:160] = chunks[100]
    chunks[200:205] = 0
    chunks[300:340] *= 40
    chunks[340:350] *= 30_000
    questions = draw.integers(0, 3, (40, 16)) * (draw.random((40, 16)) < 0.4)
    questions[:4], questions[4] = chunks[[100, 7, 345, 310]], 0
    questions[5:9] *= 100
    monkeypatch.setattr(retrieval, "_FIRST_CHUNKS", 10)
    monkeypatch.setattr(retrieval, "_NUMBERS_TOGETHER", 2)
    monkeypatch.setattr(retrieval, "_NUMBERS_PER_TILE", 6)
    monkeypatch.setattr(retrieval, "_COUNTED_QUESTIONS", 7)
    floor = -math.inf if min_score is None else min_score
    rows = [(i // 3, i % 3) for i in range(len(chunks))]
    batch = pa.RecordBatch.from_arrays(
        [*(pa.array(ids) for ids in zip(*rows)), embedding.as_lists(chunks)],
        names=["document_id", "chunk_index", "embedding"],
    )
    search = retrieval._Search(k, floor, None, [])
    compared, reaching = [], search._reaching
    monkeypatch.setattr(
        search,
        "_reaching",
        lambda asked, *given: compared.append(len(asked) * len(given[1])) or reaching(asked, *given),
    )
    ids = pa.array(range(len(questions)))
    batches = [batch.slice(at, 450) for at in (0, 450)]
    found = pa.Table.from_batches(list(search.task(ids, questions.astype(np.float32), iter(batches))))
    best = {}
    for row in sorted(found.to_pylist(), key=lambda r: (-r["score"], r["document_id"], r["chunk_index"])):
        own = best.setdefault(row["query_id"], [])
        own.append((row["document_id"], row["chunk_index"], row["score"]))
    got = {(q, rank): row for q, own in best.items() for rank, row in enumerate(own, 1)}
    assert got == brute_force(questions.astype(float), chunks.astype(float), k, floor)
    if k == 3 and min_score is None:
        assert sum(compared) < len(questions) * len(chunks) / 3
    ranked = retrieval.top_k_chunks(
        question_frame(spark, questions.astype(float)),
        chunk_frame(spark, chunks.astype(float)),
        k,
        min_score,
        question_bytes=5 * 8 * 16,
    )
    assert as_ranks(ranked) == got


def test_vectors_as_bytes_are_the_same():
    draw = np.random.default_rng(3)
    odd = np.array([[np.nan, 1], [1, 2], [256, 0], [255, 0], [-1, 0], [0.5, 1], [np.inf, 0]])
    for made in (draw.integers(0, 9, (40, 6)), draw.integers(0, 400, (40, 6)), draw.standard_normal((40, 6)), np.zeros((0, 6)), odd):
        made = made.astype(np.float32)
        packed = embedding.packed_vectors(made)
        for part in (slice(None), slice(2, 5)):
            got = embedding.unpacked_vectors(packed[part], made.shape[1])
            assert np.array_equal(got, made[part], equal_nan=True)
    assert len(embedding.packed_vectors(np.ones((1, 256)))[0].as_py()) == 257
    with pytest.raises(ValueError):
        embedding.unpacked_vectors(embedding.packed_vectors(np.ones((3, 8))), 32)


@pytest.mark.parametrize("embedder", [embedding.HashedEmbedder(), lambda texts: embedding.HashedEmbedder()(texts) / 3 - 0.01])
def test_chunks_meet_questions_as_bytes(spark, plan, embedder):
    """In a grid vectors of counts take a byte a value, others as before; texts that are not
    asked for stay behind."""
    draw = np.random.default_rng(6)
    texts = [" ".join(f"w{n}" for n in draw.integers(0, 60, 20)) for _ in range(300)]
    chunks = spark.createDataFrame([(i // 3, i % 3, t) for i, t in enumerate(texts)], "document_id long, chunk_index long, chunk_text string")
    questions = spark.createDataFrame(list(enumerate(texts[:40])), "query_id long, query string")
    asked = embedding.embed(questions, "query", embedder)
    met = {
        limit: retrieval.top_k_chunks(asked, chunks, embedder=embedder, carry=carry, question_bytes=limit)
        for limit, carry in ((1 << 20, ()), (5 * 8 * 256, ()), (6 * 8 * 256, ("chunk_text",)))
    }
    packed = embedding.embed_packed(questions, "query", embedder)
    for limit in met:
        given = retrieval.top_k_chunks(packed, chunks, embedder=embedder, question_bytes=limit)
        assert as_ranks(given) == as_ranks(met[limit])
    whole, small, carried = met.values()
    assert "packed" in plan(small) and "packed" not in plan(whole)
    assert as_ranks(small) == as_ranks(whole) == as_ranks(carried)
    assert {(r.document_id * 3 + r.chunk_index, r.chunk_text) for r in carried.collect()} <= set(enumerate(texts))


def test_products_below_4096_are_in_single_precision(monkeypatch):
    """Two to a number; a number with one threshold has all its shares."""
    draw = np.random.default_rng(7)
    chunks = draw.integers(0, 6, (3000, 64)).astype(np.float32)
    questions = draw.integers(0, 5, (50, 64)).astype(np.float32)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(3000)), pa.array([0] * 3000), embedding.as_lists(chunks)],
        names=["document_id", "chunk_index", "embedding"],
    )
    kinds = []
    product = np.matmul
    monkeypatch.setattr(np, "matmul", lambda a, b, out: kinds.append(a.dtype) or product(a, b, out=out))
    search = retrieval._Search(3, -math.inf, None, [])
    found = pa.Table.from_batches(list(search.task(pa.array(range(50)), questions, iter([batch]))))
    scores = np.round(questions.astype(float) @ chunks.T.astype(float) / np.outer(*(np.sqrt((x.astype(float) ** 2).sum(1)) for x in (questions, chunks))), 12)
    for row in found.to_pylist():
        assert row["score"] == scores[row["query_id"], row["document_id"]]
        assert (scores[row["query_id"]] > row["score"]).sum() < 3
    assert found.num_rows == 150 and set(kinds) == {np.dtype(np.float32)}


@pytest.mark.parametrize("cells, partitions", [(1, 2), (9, 18), (32, 64), (500, 1000), (50, 20)])
def test_cells_are_dealt_evenly(spark, cells, partitions):
    keys = retrieval.cell_keys(cells, partitions)
    assert len(set(keys)) == cells
    frame = spark.createDataFrame([(key,) for key in keys], "key int").repartition(partitions, "key")
    held = frame.groupBy(F.spark_partition_id()).count().collect()
    assert max(row["count"] for row in held) == -(-cells // partitions)
