"""Hard negatives and cover trees against all inner products."""

import random

import numpy as np
from pyspark.sql import functions as F

from paperloom.llm.cover_tree import CoverTree, Window
from paperloom.llm.hard_negatives import Plan, mine, whole_numbers
from paperloom.llm.queries import op11_hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int"


def clustered(draw, rows, width, clusters=12):
    middles = draw.integers(-200, 200, (clusters, width))
    out = middles[draw.integers(0, clusters, rows)] + draw.integers(-9, 10, (rows, width))
    out[draw.random(rows) < 0.2] = middles[0]  # copies
    return out


def by_all(vectors, query, window, allowed, ids):
    scores = vectors.astype(object) @ query.astype(object)
    inside = [p for p in range(len(ids)) if allowed[p] and window.low <= scores[p] <= window.high]
    return [(p, scores[p]) for p in sorted(inside, key=lambda p: (-scores[p], ids[p], p))[: window.k]]


def test_search_equals_all_products():
    draw = np.random.default_rng(1)
    for rows, width, scale in ((0, 3, 1), (1, 3, 1), (40, 2, 1), (700, 8, 1), (500, 64, 1), (400, 5, 2**17)):
        vectors = clustered(draw, rows, width) * scale
        ids = draw.integers(0, max(rows // 2, 1), rows)
        tree, more = CoverTree.load(CoverTree.build(vectors, leaf=8).dump(ids=ids))
        assert sorted(tree.order.tolist()) == list(range(rows)) and (more["ids"] == ids).all()
        for _ in range(12 if rows else 1):
            query = draw.integers(-200, 200, width) * scale
            allowed = draw.random(rows) < 0.7
            top = float(max([0, *(vectors @ query)]))
            windows = [Window(-(2.0**63), 2.0**63, 5), Window(0.3 * top, 0.9 * top, 10), Window(5, 4, 3)]
            found, _ = tree.search(query, windows, allowed, ids)
            for window, (points, scores) in zip(windows, found):
                assert list(zip(points, scores)) == by_all(vectors, query, window, allowed, ids)


def test_nodes_cover_their_points_and_keep_apart():
    vectors = clustered(np.random.default_rng(2), 800, 6)
    tree = CoverTree.build(vectors, leaf=4)
    squares = (vectors.astype(float) ** 2).sum(axis=1)
    lifted = np.column_stack([vectors, np.sqrt(squares.max() - squares)])
    for k in range(len(tree.centre)):
        members = tree.order[tree.first[k] : tree.last[k]]
        far = np.linalg.norm(lifted[members] - lifted[tree.centre[k]], axis=1)
        assert far.max() <= tree.radius[k] + 1e-3
        below = np.arange(tree.child[k], tree.child[k] + tree.children[k])
        middles = lifted[tree.centre[below]]
        for i in range(1, len(below)):
            apart = np.linalg.norm(middles[:i] - middles[i], axis=1)
            assert apart.min() > tree.radius[k] / 2 - 1e-3


def test_clusters_outside_a_window_are_not_opened():
    draw = np.random.default_rng(3)
    vectors = clustered(draw, 4000, 16, 40)
    tree = CoverTree.build(vectors)
    query, allowed = vectors[17], np.ones(4000, bool)
    top = float(max(vectors @ query))
    _, opened = tree.search(query, [Window(0.3 * top, 0.9 * top, 10)], allowed, np.arange(4000))
    assert opened < 0.5 * len(tree.centre)


def mined_by_hand(rows, is_anchor, plan):
    """Rows of (id, vector, label) that take part."""
    vectors = whole_numbers([v for _, v, _ in rows], plan.scale).astype(object)
    out = []
    for a, (anchor, _, label) in enumerate(rows):
        if not is_anchor(anchor):
            continue
        scores = vectors @ vectors[a]
        order = sorted(range(len(rows)), key=lambda p: (-scores[p], rows[p][0]))
        positives = [p for p in order if p != a and rows[p][2] == label][: plan.positives]
        for positive in positives:
            s = scores[positive]
            inside = [
                p for p in order
                if rows[p][2] != label and plan.low * s <= 100 * scores[p] <= plan.high * s
            ]
            for rank, p in enumerate(inside[: plan.negatives], 1):
                out.append((anchor, rows[positive][0], rank, rows[p][0], int(s), int(scores[p])))
    return sorted(out)


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    rows = [
        (r.vec_id, [float(x) for x in r.embedding], (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label)
        for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    ]
    got = sorted(tuple(r) for r in op11_hard_negatives(spark, folder).collect())
    assert got and got == mined_by_hand(rows, lambda i: i % 100 == 0, Plan())


def test_many_blocks_and_slices_with_copies(spark):
    draw = random.Random(4)
    middles = [[draw.uniform(-1, 1) for _ in range(6)] for _ in range(8)]
    rows = []
    for i in range(400):
        vector = [x + draw.uniform(-0.2, 0.2) for x in draw.choice(middles)]
        rows.append((i, middles[0] if draw.random() < 0.3 else vector, draw.randrange(3)))
    rows.append((400, [0.0] * 6, 1))
    plan = Plan(rows=50, anchors=7)
    frame = spark.createDataFrame(rows, SCHEMA)
    got = sorted(tuple(r) for r in mine(frame, F.col("vec_id") % 10 == 0, plan).collect())
    assert got == mined_by_hand(rows, lambda i: i % 10 == 0, plan)


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (100, [1.0, 0.5], 1), (100, [1.0, 0.5], 1), (1, [0.9, 0.5], 1), (2, [0.5, 0.1], 2), (3, [0.5, 0.1], 2),
        (3, [0.5, 0.1], 2), (4, [0.6], 3), (200, [-1.0, 1.0, 2.0], 4), (5, [1e9, -1e300], 5), (300, [0.1, 0.1], 6),
    ]
    gone = [
        (400, None, 1), (500, [1.0, None], 1), (600, [nan, 1.0], 1), (700, [inf, 1.0], 1), (800, [1.0, 0.5], None),
        (None, [1.0, 0.5], 1),
    ]
    frame = spark.createDataFrame(rows + gone, SCHEMA).selectExpr("*", "1 as tree", "2 as block", "3 as vector")
    asks = F.col("vec_id") % 100 == 0
    got = [tuple(r) for r in mine(frame, asks).collect()]
    assert sorted(got) == mined_by_hand(rows, lambda i: i % 100 == 0, Plan())
    assert {r[0] for r in got} == {100} and (100, 100) in {r[:2] for r in got}
    assert mine(frame.limit(0), asks).count() == 0
    assert mine(frame.filter("vec_id < 100"), asks).count() == 0
    assert whole_numbers([[0.999 / 256, -1e-9], [1e30]], 256).tolist() == [[0, -1], [2**26, 0]]
