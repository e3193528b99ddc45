"""Nearest vectors against all inner products computed."""

import math

import numpy as np
import pytest

from paperloom.llm.ann import Plan, nearest
from paperloom.llm.queries import op2_nearest_vectors

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>"


def by_brute_force(rows, queries, k):
    ids = np.array([i for i, _ in rows])
    vectors = np.array([v for _, v in rows], np.float32).astype(float)
    out = {}
    for q in queries:
        own = vectors[ids == q][0]
        scores = (vectors * own).sum(axis=1)
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), scores[i]) for i in order]
    return out


def grouped(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def recall(got, want):
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    return hits / sum(len(x) for x in want.values())


def test_query_recall_and_scores(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    rows = [(r.vec_id, r.embedding) for r in rows]
    frame = op2_nearest_vectors(spark, FOLDER)
    assert frame.columns == ["query_id", "rank", "vec_id", "score"]
    got, want = grouped(frame), by_brute_force(rows, [i for i, _ in rows if i % 20 == 0], 20)
    assert set(got) == set(want) and all(len(x) == 20 for x in got.values())
    assert recall(got, want) >= 0.95
    exact = {q: dict(by_brute_force(rows, [q], len(rows))[q]) for q in got}
    for q, found in got.items():
        assert all(exact[q][i] == pytest.approx(s, abs=1e-12) for i, s in found)
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))


@pytest.mark.parametrize("scale", [0.0, 1.0])
def test_recall_over_blocks_with_and_without_unit_length(spark, scale):
    draw = np.random.default_rng(3)
    vectors = draw.standard_normal((3000, 32))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    vectors *= np.exp(scale * draw.standard_normal(3000))[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    plan = Plan(vectors=700, queries=40)
    got = grouped(nearest(frame, frame["vec_id"] % 20 == 0, plan=plan))
    assert recall(got, by_brute_force(rows, range(0, 3000, 20), 20)) >= 0.93


def test_edge_cases(spark):
    one = [1.0, 2.0, 0.0]
    rows = [
        (0, one), (20, None), (40, [0.0, 0.0, 0.0]), (60, [1.0, None, 2.0]), (80, [math.nan] * 3),
        (100, [math.inf, 1.0, 1.0]), (120, []), (7, one), (5, one), (5, one), (3, [3.0, 0.0, 0.0]),
        (None, one), (140, [1.0, 2.0]), (9, [-1.0, -2.0, 0.0]), (11, [math.nan, 1.0, 1.0]),
    ]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as row", "2 as score")
    asks = frame["vec_id"] % 20 == 0
    got = grouped(nearest(frame, asks))
    assert got == {0: [(5, 5.0), (5, 5.0), (7, 5.0), (3, 3.0), (9, -5.0)]}
    assert grouped(nearest(frame, asks, k=1)) == {0: [(5, 5.0)]}
    assert nearest(frame.limit(0), asks).count() == 0


def test_rows_that_share_an_id_are_rows_of_their_own(spark):
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [0.0, 2.0]), (3, [1.0, 1.0])]
    frame = spark.createDataFrame(rows * 30, SCHEMA)
    got = sorted(tuple(r) for r in nearest(frame, frame["vec_id"] == 20, k=70, plan=Plan(vectors=2)).collect())
    # Of 60 equal rows each finds the 59 others, then rows of id 3 (equal score, smaller id first).
    first = [(20, r + 1, 3, 1.0) for r in range(30)] + [(20, r + 31, 20, 1.0) for r in range(40)]
    second = [(20, r + 1, 20, 4.0) for r in range(29)] + [(20, r + 30, 3, 2.0) for r in range(30)]
    second += [(20, r + 60, 20, 0.0) for r in range(11)]
    assert got == sorted(first * 60 + second * 30)


def test_a_third_of_all_vectors_alike(spark):
    draw = np.random.default_rng(4)
    rows = [(i, ([1.0] * 8 if i % 3 else draw.standard_normal(8).tolist())) for i in range(600)]
    frame = spark.createDataFrame(rows, SCHEMA)
    plan = Plan(vectors=100)
    got = grouped(nearest(frame, frame["vec_id"] % 20 == 0, plan=plan))
    want = by_brute_force(rows, range(0, 600, 20), 20)
    assert recall(got, want) >= 0.95
    assert [i for i, _ in got[20]] == [i for i, _ in want[20]]
