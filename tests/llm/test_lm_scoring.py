"""Scores against a dictionary-based model over the whole corpus."""

import math
import random
import re
import zlib
from collections import Counter

import pytest

from paperloom.llm.lm_scoring import Plan, score_documents
from paperloom.llm.queries import op1_lm_scoring

FOLDER = "/root/testdata/sf0.001"


def tokens_of(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered) + [None]


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 10 == 0 if doc_id is not None else True


def by_brute_force(rows, plan):
    rows = [(i, tokens_of(text)) for i, text in rows]
    counts = Counter()
    for doc_id, tokens in rows:
        if not held_out(doc_id):
            row = ["<s>", *tokens]
            for n in range(1, plan.order + 1):
                counts.update(tuple(row[i : i + n]) for i in range(len(row) - n + 1))
    single = {k: c for k, c in counts.items() if len(k) == 1 and k != ("<s>",)}
    total, types = sum(single.values()), len(single)

    def share(gram):
        if len(gram) == 1:
            return (counts[gram] + plan.added) / (total + plan.added * (types + 1))
        seen = counts[gram[:-1]]
        lower = share(gram[1:])
        if not seen:
            return lower
        lent = plan.discount[len(gram) - 2] * seen ** -plan.fall[len(gram) - 2]
        return (1 - lent) * counts[gram] / seen + lent * lower

    out = []
    for doc_id, tokens in rows:
        row = ["<s>", *tokens]
        score = sum(
            math.log10(share(tuple(row[max(0, i - plan.order + 1) : i + 1])))
            for i in range(1, len(row))
        )
        base = sum(math.log10(share((t,))) for t in tokens)
        known = sum(counts[(t,)] > 0 for t in tokens)
        out.append((doc_id, held_out(doc_id), len(tokens), known, total, base, score))
    return out


def compare(got, want):
    def key(r):
        return (r[0] is not None, r[0] or 0, *r[2:4], round(r[6], 3))

    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want):
        assert a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-9)


def test_query_equals_brute_force_and_beats_single_words(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    frame = op1_lm_scoring(spark, FOLDER)
    assert frame.columns == [
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    ]
    got = frame.collect()
    compare(got, by_brute_force([tuple(r) for r in rows], Plan()))
    unseen = [r for r in got if r.held_out]
    assert unseen and sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_orders_blocks_and_parts(spark, order):
    draw = random.Random(order)
    plan = Plan(
        order, (0.9, 0.6, 0.5), (0.1, 0.05, 0.0), block_chars=400, part_words=40
    )
    rows = [
        (i, " ".join(draw.choice("a b C cc d é the of".split()) for _ in range(draw.randrange(30))))
        for i in range(150)
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    compare(score_documents(frame, plan).collect(), by_brute_force(rows, plan))


def test_edge_cases(spark):
    rows = [
        (1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "a b"), (4, "A\x0bb\x1fc a"),
        (5, "x " * 30_000),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    frame = frame.selectExpr("*", "'k' as block", "1 as score")
    compare(score_documents(frame).collect(), by_brute_force(rows, Plan()))
    assert score_documents(frame.limit(0)).count() == 0
    only = frame.filter("doc_id is null")
    got = score_documents(only).collect()
    assert got[0].train_tokens == 0 and got[0].n_known == 0 and got[0].score == got[0].base_score


def test_keys_seldom_meet_at_thirty_gigabytes():
    """README: one lookup in 100,000 met a foreign key with 50 bits."""
    assert 1e-5 / 2 ** (Plan().key_bits - 50) < 1e-6
