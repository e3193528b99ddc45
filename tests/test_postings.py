"""Search over the inverted index against cosines of all pairs."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from paperloom.operators import postings
from paperloom.operators.embedding import words_of
from paperloom.plans import index_flow

SCHEMA = "document_id long, chunk_index int, chunk_text string"


def by_hand(questions, chunks, k):
    held = {(d, c): Counter(words_of(text or "")) for d, c, text in chunks}
    spread = Counter(word for own in held.values() for word in own)
    idf = {word: math.log1p(len(chunks) / n) for word, n in spread.items()}

    def weights(words):
        own = {w: n * idf[w] for w, n in words.items() if w in idf}
        length = math.sqrt(sum(x * x for x in own.values()))
        return {w: x / length for w, x in own.items()}

    chunk_weights = {key: weights(own) for key, own in held.items()}
    out = {}
    for query_id, text in questions:
        asked = weights(Counter(words_of(text or "")))
        scored = []
        for key, own in chunk_weights.items():
            shared = [asked[w] * own[w] for w in asked if w in own]
            if shared:
                scored.append((-round(sum(shared), 10), *key))
        for rank, (score, d, c) in enumerate(sorted(scored)[:k], 1):
            out[query_id, rank] = (d, c, pytest.approx(-score, abs=2e-10))
    return out


@pytest.fixture(scope="module")
def tables():
    draw = random.Random(8)
    words = [f"w{n}" for n in range(300)]
    common = ["the", "of"]

    def text(size):
        return " ".join(draw.choice(common) if draw.random() < 0.3 else draw.choice(words) for _ in range(size))

    chunks = [(i // 5, i % 5, text(draw.randrange(3, 30))) for i in range(2500)]
    chunks += [(900 + i, 0, "same words here") for i in range(700)]
    chunks += [(5000, 0, None), (5000, 1, ""), (5000, 2, "... !"), (5001, 0, "Über ÜBER straße the")]
    questions = [(f"q{i}", text(draw.randrange(1, 9))) for i in range(40)]
    questions += [("copies", "same here"), ("all", "the"), ("odd", "über, STRASSE w1"), ("none", "zzz"), ("empty", ""), ("null", None)]
    return questions, chunks


def question_frame(spark, rows):
    return spark.createDataFrame(rows, "query_id string, query string")


@pytest.mark.parametrize("per_shard,per_slice,k", [(20_000, 2_000, 3), (700, 11, 3), (700, 2_000, 40)])
def test_search_is_exact(spark, tables, tmp_path, per_shard, per_slice, k):
    questions, chunks = tables
    frame = spark.createDataFrame(chunks, SCHEMA).repartition(3)
    index_flow.build_postings(frame, str(tmp_path), per_shard)
    index = index_flow.stored_postings(spark, str(tmp_path))
    asked = question_frame(spark, questions)
    got = postings.search(asked, index, k, questions_per_slice=per_slice).collect()
    found = {(r.query_id, r["rank"]): (r.document_id, r.chunk_index, r.score) for r in got}
    assert found == by_hand(questions, chunks, k)
    shards = index.filter(f"bucket = {postings.KEYS}").count()
    assert shards == -(-len(chunks) // per_shard)


def test_blocks_that_cannot_win_stay_closed(spark, tmp_path):
    draw = random.Random(2)
    rows = [(i, 0, " ".join(["the", *(f"x{draw.randrange(60)}" for _ in range(12))])) for i in range(8000)]
    rows += [(9000 + i, 0, f"rare{i} the x1") for i in range(5)]
    index_flow.build_postings(spark.createDataFrame(rows, SCHEMA), str(tmp_path))
    index = index_flow.stored_postings(spark, str(tmp_path))
    asked = question_frame(spark, [(str(i), f"the rare{i}") for i in range(5)])
    for r in postings.opened(asked, index).collect():
        assert r.postings > 8000 and r.opened < 0.4 * r.postings


def test_only_words_of_the_questions_are_read(spark, tables, tmp_path, plan):
    _, chunks = tables
    index_flow.build_postings(spark.createDataFrame(chunks, SCHEMA), str(tmp_path))
    index = index_flow.stored_postings(spark, str(tmp_path))
    text = plan(postings.search(question_frame(spark, [("a", "w1 w2")]), index))
    scans = [part.split("\n\n")[0] for part in text.split("Scan parquet")[1:]]
    filters = [scan for scan in scans if "weights:binary" in scan]
    assert filters and all("PartitionFilters: [" in scan and "bucket" in scan for scan in filters)
    buckets = {r.bucket for r in index.select("bucket").distinct().collect()}
    assert len(buckets) > 30


def test_blocks_hold_their_largest_weight(spark, tables):
    _, chunks = tables
    counted = postings.shard_counts(spark.createDataFrame(chunks, SCHEMA), 900)
    rows = postings.weighted_postings(counted).collect()
    squares = {}
    for r in rows:
        if r.term is None:
            continue
        blocks, ends = (np.frombuffer(x, "<i4") for x in (r.blocks, r.ends))
        most, weights = (np.frombuffer(x, "<f8") for x in (r.most, r.weights))
        places = np.frombuffer(r.places, np.uint8)
        starts = [0, *ends[:-1]]
        assert len(places) == len(weights) == ends[-1] and (np.diff(blocks) > 0).all()
        for block, a, b, top in zip(blocks, starts, ends, most):
            assert weights[a:b].max() == top and (np.diff(places[a:b].astype(int)) > 0).all()
            for place, weight in zip(places[a:b], weights[a:b]):
                key = (r.shard, block * 256 + place)
                squares[key] = squares.get(key, 0) + weight**2
    assert len(squares) == sum(1 for *_, text in chunks if words_of(text or ""))
    assert all(abs(x - 1) < 1e-9 for x in squares.values())


def test_empty_tables(spark, tables, tmp_path):
    questions, chunks = tables
    none = spark.createDataFrame([], SCHEMA)
    index_flow.build_postings(none, str(tmp_path / "a"))
    assert index_flow.search_postings(question_frame(spark, questions), str(tmp_path / "a")).count() == 0
    index_flow.build_postings(spark.createDataFrame(chunks, SCHEMA), str(tmp_path / "b"))
    assert index_flow.search_postings(question_frame(spark, questions[:0]), str(tmp_path / "b")).count() == 0


def test_cells_stay_in_tasks_of_their_own(spark, tables, tmp_path, plan):
    """Few bytes, but long work: cells are not put together, and a question is one row."""
    questions, chunks = tables
    index_flow.build_postings(spark.createDataFrame(chunks, SCHEMA), str(tmp_path), 700)
    index = index_flow.stored_postings(spark, str(tmp_path))
    asked = question_frame(spark, questions)
    cells = postings._cells(asked, index, 3, "query", 11)
    shards, slices = -(-len(chunks) // 700), -(-len(questions) // 11)
    assert cells.rdd.getNumPartitions() >= shards * slices
    assert "collect_list" in plan(cells)


def test_counts_are_made_where_chunks_are_read(spark, tables, plan):
    """Texts stay where they are: what goes on are counts, as compressed arrays."""
    _, chunks = tables
    counted = postings.shard_counts(spark.createDataFrame(chunks, SCHEMA), 700)
    assert "Exchange" not in plan(counted)
    lists = plan(postings.posting_lists(counted))
    assert "SortMergeJoin" not in lists and "chunk_text" not in lists.split("Exchange")[0]


def test_index_takes_less_than_its_texts(spark, tmp_path):
    """Many words that one chunk holds, which make a row each costly."""
    draw = random.Random(4)
    texts = [" ".join(f"{draw.choice('abc')}{draw.randrange(400 if n % 3 else 10**6)}" for n in range(150)) for _ in range(3000)]
    rows = [(i, 0, text) for i, text in enumerate(texts)]
    index_flow.build_postings(spark.createDataFrame(rows, SCHEMA).repartition(3), str(tmp_path), 600)
    stored = sum(path.stat().st_size for path in tmp_path.rglob("*.parquet"))
    assert stored < 3 * sum(len(text) for text in texts)
    index = index_flow.stored_postings(spark, str(tmp_path))
    assert index.count() == 5 * (postings.BUCKETS + 1)


@pytest.mark.parametrize(
    "limits",
    [{"_WORD_BYTES": 0}, {"_COUNTS_PER_PACK": 100, "_CHARACTERS_AT_ONCE": 300}, {"_SHARDS_TOGETHER": 40, "_GROUPS_PER_CORE": 1}],
)
def test_search_is_exact_at_any_limit(spark, tables, tmp_path, monkeypatch, limits):
    """All words passed on; packs of few counts; shards one after another, with a floor."""
    questions, chunks = tables
    for name, value in limits.items():
        monkeypatch.setattr(postings, name, value)
    frame = spark.createDataFrame(chunks, SCHEMA).repartition(3)
    index_flow.build_postings(frame, str(tmp_path), 90)
    index = index_flow.stored_postings(spark, str(tmp_path))
    got = postings.search(question_frame(spark, questions), index, 3, questions_per_slice=7).collect()
    found = {(r.query_id, r["rank"]): (r.document_id, r.chunk_index, r.score) for r in got}
    assert found == by_hand(questions, chunks, 3)
    assert index.filter(f"bucket = {postings.KEYS}").count() == -(-len(chunks) // 90)


@pytest.mark.parametrize("kind", ["timestamp", "int", "decimal(9,2)"])
def test_search_takes_ids_of_other_types(spark, tables, tmp_path, kind):
    _, chunks = tables
    index_flow.build_postings(spark.createDataFrame(chunks, SCHEMA), str(tmp_path), 700)
    asked = spark.sql(f"SELECT CAST(CAST(id AS INT) AS {kind}) AS query_id, 'w1 w2' AS query FROM range(3)")
    found = index_flow.search_postings(asked, str(tmp_path))
    assert found.schema["query_id"].dataType == asked.schema["query_id"].dataType
    rows = found.collect()
    assert len(rows) == 9 and len({(r.document_id, r.chunk_index) for r in rows}) == 3
    assert {r.query_id for r in rows} == {r.query_id for r in asked.collect()}
