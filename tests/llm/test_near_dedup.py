"""Near-duplicates against all pairs compared by brute force."""

import random
import re

import numpy as np
import pandas as pd
import pytest

from paperloom.llm import near_dedup
from paperloom.llm.near_dedup import Plan, near_duplicates, one_of_each
from paperloom.llm.queries import op8_near_dedup

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def shingle_set(text, width):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return set()
    width = min(width, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def by_brute_force(rows, width, percent=80):
    sets = [shingle_set(text, width) for _, text in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                    parent[top(i)] = top(j)
    smallest = {}
    for i, (doc_id, _) in enumerate(rows):
        smallest[top(i)] = min(doc_id, smallest.get(top(i), doc_id))
    return sorted((rows[i][0], len(sets[i]), smallest[top(i)]) for i in range(len(rows)))


def found(frame):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in frame.collect())


def edited(text, share, draw):
    words = text.split(" ")
    return " ".join("w%d" % draw.randrange(10**6) if draw.random() < share else w for w in words)


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    frame = op8_near_dedup(spark, FOLDER)
    assert frame.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert found(frame) == by_brute_force([tuple(r) for r in rows], 2)
    assert all(r.kept == (r.doc_id == r.component_id) for r in frame.collect())


@pytest.mark.parametrize("width", [2, 5])
def test_chains_and_groups_about_the_threshold(spark, width):
    draw = random.Random(width)
    rows = []
    for group in range(6):
        base = " ".join("g%dx%d" % (group, draw.randrange(10**6)) for _ in range(150))
        chain = base
        for _ in range(25):
            share = draw.choice([0.0, 0.01, 0.02, 0.05, 0.1])
            rows.append(edited(base, share, draw))
            chain = edited(chain, 0.02, draw)
            rows.append(chain)
    draw.shuffle(rows)
    rows = [(7 * i + 3, text) for i, text in enumerate(rows)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = found(near_duplicates(frame, Plan(width=width, cell=16)))
    assert got == by_brute_force(rows, width)


def test_edge_cases(spark):
    long = "lorem ipsum " * 20_000
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (5, "ONE"), (6, "one two"),
        (7, "One  two"), (8, long), (9, long + "x"), (None, "one"), (None, None), (10, "Éa"),
        (11, "éa"),
    ]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as node", "'x' as Signature")
    got = {}
    for r in near_duplicates(frame, Plan(width=2)).collect():
        got.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert got[1] == [(0, 1, True)] and got[2] == [(0, 2, True)] and got[3] == [(0, 3, True)]
    assert got[4] == [(1, 4, True)] and got[5] == [(1, 4, False)] * 2
    assert got[6] == [(1, 6, True)] and got[7] == [(1, 6, False)]
    assert got[8] == [(2, 8, True)] and got[9] == [(3, 9, True)]
    assert sorted(got[None]) == [(0, None, True), (1, 4, False)]
    assert got[10] == [(1, 10, True)] and got[11] == [(1, 11, True)]
    assert sorted(str(r.doc_id) for r in one_of_each(frame, Plan(width=2)).collect()) == sorted(
        ["1", "2", "3", "4", "6", "8", "9", "None", "10", "11"]
    )
    assert one_of_each(frame, Plan(width=2)).columns == frame.columns
    assert near_duplicates(frame.limit(0)).count() == 0


def test_only_null_ids(spark):
    frame = spark.createDataFrame([(None, "a b c"), (None, "a b c")], SCHEMA)
    assert [tuple(r)[2:] for r in near_duplicates(frame).collect()] == [(1, None, True)] * 2


def test_members_that_miss_their_hub_meet_each_other(spark, monkeypatch):
    """Without any link to a hub, the pairs of different components find all links."""
    monkeypatch.setattr(near_dedup, "_confirmed", lambda pairs, sets, plan: pairs.limit(0))
    draw = random.Random(5)
    rows = []
    for _ in range(4):
        base = " ".join("w%d" % draw.randrange(10**6) for _ in range(100))
        rows += [(100 * len(rows) + i, edited(base, draw.choice([0.02, 0.04, 0.2]), draw)) for i in range(9)]
    for plan in (Plan(width=2), Plan(width=2, cell=3), Plan(width=2, items=250)):
        got = found(near_duplicates(spark.createDataFrame(rows, SCHEMA), plan))
        assert got == by_brute_force(rows, 2)


def test_cells_hand_on_fewer_links_than_members(spark):
    """A large group about the threshold: its links are as many as its pairs."""
    draw = random.Random(6)
    base = " ".join("w%d" % draw.randrange(10**6) for _ in range(120))
    texts = [edited(base, 0.045, draw) for _ in range(150)]
    sets = [sorted(shingle_set(t, 2)) for t in texts]
    joined = near_dedup.word_hashes(texts)
    items = [near_dedup.shingles(joined[0][a:b], 2) for a, b in zip(joined[1][:-1], joined[1][1:])]
    assert [len(x) for x in items] == [len(x) for x in sets]
    rows = pd.DataFrame(
        {"node": [b"%03d" % i for i in range(150)], "root": [b"%03d" % i for i in range(150)],
         "items": [x.tobytes() for x in items]}
    )
    i, j = np.triu_indices(150, 1)
    links = near_dedup._forest(rows, i, j, Plan(width=2))
    assert 0 < len(links) < 150
    want = by_brute_force(list(enumerate(texts)), 2)
    assert len({c for _, _, c in want}) == 150 - len(links)
