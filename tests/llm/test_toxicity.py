"""Toxicity: the machine's formula, what only pairs tell, held-out labels, edge cases."""

import math
import random
import zlib

import numpy as np

from paperloom.llm.queries import op12_toxicity
from paperloom.llm.toxicity import Machine, Plan, fit, learn, score_documents, terms_of, words_of

FOLDER = "/root/testdata/sf0.1"
SMALL = Plan(bits=14, telling=256, frequent=32)


def rows_of(lists):
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    return np.array([n for x in lists for n in x], np.int64), offsets


def by_pairs(machine, numbers):
    context = sum(n >= machine.telling for n in numbers)
    x = [1 if n < machine.telling else 1 / math.sqrt(context) for n in numbers]
    raw = machine.base + sum(machine.weights[n] * v for n, v in zip(numbers, x))
    for i, a in enumerate(numbers):
        for j, b in enumerate(numbers[:i]):
            raw += float(machine.factors[a] @ machine.factors[b]) * x[i] * x[j]
    return 1 / (1 + math.exp(-raw))


def test_scores_are_those_of_all_pairs():
    draw = np.random.default_rng(1)
    machine = Machine(4, np.zeros(0), 6, -0.3, draw.normal(size=10), draw.normal(size=(10, 3)))
    lists = [sorted(draw.choice(10, n, replace=False).tolist()) for n in (0, 1, 4, 0, 9, 2, 0)]
    got = machine.scores(*rows_of(lists))
    assert np.allclose(got, [by_pairs(machine, x) for x in lists])


def test_pairs_tell_what_single_terms_cannot():
    """Toxic: an insult with the group it is meant for; each alone, or crossed, is not."""
    draw = random.Random(3)
    lists, labels = [], []
    for _ in range(2000):
        insult, group = draw.randrange(2), draw.randrange(2)
        lists.append([insult, 2 + group, *sorted(draw.sample(range(4, 20), 4))])
        labels.append(float(insult == group))
    flat, offsets = rows_of(lists)
    plan = Plan(rounds=30)
    start = Machine(4, np.zeros(0), 4, 0.0, np.zeros(20), np.zeros((20, plan.factors)))
    with_pairs = fit(flat, offsets, np.array(labels), start, plan).scores(flat, offsets)
    alone = start._replace(factors=np.zeros((20, 0)))
    without = fit(flat, offsets, np.array(labels), alone, plan._replace(factors=0)).scores(flat, offsets)
    right = lambda p: np.mean((p >= 0.5) == np.array(labels))
    assert right(with_pairs) >= 0.98 and right(without) <= 0.65


def test_query_on_labels_it_never_saw(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    frame = op12_toxicity(spark, FOLDER)
    assert frame.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = frame.collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    unseen = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    toxic = [p for y, p in unseen if y]
    clean = [p for y, p in unseen if not y]
    assert sum(toxic) >= 0.75 * len(toxic) and sum(clean) <= 0.01 * len(clean)


def test_edge_cases(spark):
    draw = random.Random(5)
    docs, labels = [], []
    for i in range(400):
        words = draw.choices("sun moon tree road fish cloud".split(), k=20)
        if i % 4 == 0:
            words.insert(draw.randrange(20), draw.choice(["vilewretch", "vilewretchen", "VileWretches!"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    odd = [
        (900, None), (901, ""), (None, "vilewretch tree"), (902, "a vilewretching one"), (902, "road"),
        (902, "road"), (903, "sun moon " * 50_000 + "vilewretch"), (904, "漢字 \x00  "),
    ]
    labels += [(900, 1), (901, 0), (None, 1), (5, None), (7, 0), (7, 0), (12345, 1)]
    frame = spark.createDataFrame(docs + odd, "doc_id long, text string")
    labelled = spark.createDataFrame(labels, "doc_id long, toxic int").selectExpr("*", "'x' as text")
    wide = frame.selectExpr("*", "1 as score", "2 as terms", "3 as toxic")
    machine = learn(wide, labelled, SMALL)
    out = score_documents(wide, machine)
    assert out.columns == ["doc_id", "terms", "toxic", "score"]
    rows = [(r.doc_id, r.score) for r in out.collect()]
    assert len(rows) == len(docs) + len(odd)
    scores = {}
    for doc_id, score in rows:
        scores.setdefault(doc_id, []).append(score)
    assert all((scores[i][0] >= 0.3) == (i % 4 == 0) for i in range(400))
    assert scores[900] == scores[901] and scores[901][0] < 0.5
    assert scores[None][0] >= 0.3 and scores[903][0] >= 0.3
    assert sorted(x >= 0.3 for x in scores[902]) == [False, False, True]
    again = score_documents(frame.orderBy("text").coalesce(1), learn(frame.repartition(7), labelled, SMALL))
    for r in again.collect():
        assert any(abs(r.score - x) < 1e-9 for x in scores[r.doc_id])
    assert score_documents(frame.limit(0), machine).count() == 0
    nothing = score_documents(frame, learn(frame, labelled.limit(0), SMALL))
    assert {round(r.score, 9) for r in nothing.collect()} == {round(1 / 12, 9)}
    assert learn(frame.limit(0), labelled, SMALL).weights.size == 0


def test_terms_are_words_and_their_ends():
    assert words_of("Ab ab, c_1\tÉ!") == {"ab", "c_1", "é"} and words_of(None) == set()
    assert len(terms_of("short", 20)) == 3 and len(terms_of("abcdefgh", 20)) == 7
    assert terms_of("abcdxx", 20)[1] == terms_of("abcdyyy", 20)[1]
