"""Leaks against the exact edit distance of every run."""

import random

import numpy as np

from paperloom.llm.decontamination import Items, Plan, _Item, distance_within, find_leaks, words_of
from paperloom.llm.queries import op6_decontamination

FOLDER = "/root/testdata/sf0.001"


def least_edits(item, words):
    """Edit distance to the nearest run, by the table."""
    above = np.zeros(len(words) + 1, int)
    for i, a in enumerate(item, 1):
        row = [i]
        for j, b in enumerate(words, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (a != b)))
        above = np.array(row)
    return int(above.min())


def edited(words, edits, draw):
    words = list(words)
    for _ in range(edits):
        k = draw.randrange(len(words))
        kind = draw.randrange(3)
        if kind == 0:
            words[k] = "z%d" % draw.randrange(10**6)
        elif kind == 1:
            words.insert(k, "z%d" % draw.randrange(10**6))
        else:
            del words[k]
    return words


def test_distance_is_the_exact_one():
    draw = random.Random(1)
    for _ in range(300):
        item = [draw.choice("abcd") for _ in range(draw.randrange(1, 90))]
        text = [draw.choice("abcde") for _ in range(draw.randrange(0, 120))]
        masks = {}
        for i, w in enumerate(item):
            masks[w] = masks.get(w, 0) | 1 << i
        assert distance_within(_Item(0, item, 0, masks), text) == least_edits(item, text)


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()
    frame = op6_decontamination(spark, FOLDER)
    got = {(r.doc_id, x.item_id, x.distance) for r in frame.collect() for x in r.leaks}
    want = set()
    for item in items:
        words = words_of(item.text)
        # At most a fifth of the words edited: some three in a row are as they were.
        threes = set(zip(words, words[1:], words[2:]))
        allowed = int(0.2 * len(words))
        for doc_id, text in rows:
            found = words_of(text)
            if not threes.isdisjoint(zip(found, found[1:], found[2:])):
                distance = least_edits(words, found)
                if distance <= allowed:
                    want.add((doc_id, item.item_id, distance))
    assert want and got == want
    assert frame.count() == len(rows)


def test_recall_at_the_most_edits_allowed():
    draw = random.Random(5)
    plan = Plan()
    rows = [(i, " ".join("w%d" % draw.randrange(3000) for _ in range(15 + i % 45))) for i in range(300)]
    items = Items(rows, plan)
    for share, least in ((0.2, 0.95), (0.1, 0.99), (0.0, 1.0)):
        texts = []
        for _, text in rows:
            words = text.split()
            around = ["v%d" % draw.randrange(10**6) for _ in range(60)]
            texts.append(
                " ".join(around[:30] + edited(words, int(share * len(words)), draw) + around[30:])
            )
        hits = sum(i in dict(x) for i, x in enumerate(items.found(texts)))
        assert hits >= least * len(rows)


def test_edge_cases(spark):
    item = "one two three four five six seven eight nine ten"
    docs = [
        (1, None), (2, ""), (3, f"Xx, {item.upper()}! yy"), (4, item), (4, item), (None, item),
        (5, "filler " * 50_000 + item), (6, "one two three four five"), (7, "a b c"),
        (8, item.replace("five", "5").replace("nine", "")),
    ]
    bench = [(1, item), (1, item), (2, None), (3, ""), (None, item), (4, "a b c")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "7 as leaks")
    items = spark.createDataFrame(bench, "item_id long, text string").selectExpr("*", "1 as doc_id")
    out = find_leaks(frame, items)
    got = [(r.doc_id, [tuple(x) for x in r.leaks]) for r in out.collect()]
    assert len(got) == len(docs)
    for doc_id, leaks in got:
        want = {3: [(1, 0)], 4: [(1, 0)], None: [(1, 0)], 5: [(1, 0)], 7: [(4, 0)], 8: [(1, 2)]}
        assert leaks == want.get(doc_id, [])
    parts = find_leaks(frame, items, Plan(item_chars=20))
    assert sorted(map(str, parts.collect())) == sorted(map(str, out.collect()))
    assert find_leaks(frame.limit(0), items).count() == 0
    assert all(not r.leaks for r in find_leaks(frame, items.limit(0)).collect())


def test_short_items_are_whole_lines_or_sentences():
    rows = [(1, "Who is it?"), (2, "Yes. It is!"), (3, "no"), (4, ""), (5, "one two three four five six seven")]
    items = Items(rows, Plan())
    texts = [
        "well\nWHO is it\nnever", "I know who is it now.", "Ah. Yes! It is. So", "yes it is", "no way", "", None,
        "a. no? b", "one two three. four five six seven", "one two three four five six seven eight",
    ]
    got = [[i for i, d in found if d == 0] for found in items.found(texts)]
    assert got == [[1], [], [2], [2], [], [], [], [3], [5], []]
