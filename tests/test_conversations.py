import random

import pytest

from paperloom.operators import conversations
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string"
CAP = 6


def make_turns():
    pick = random.Random(9)
    turns = []
    for conv in range(30):
        roles = ["system"] if conv % 3 == 0 else []
        roles += pick.choices(["user", "assistant"], k=pick.randint(0, 12)) if conv % 2 else ["user", "assistant"] * pick.randint(0, 6)
        if conv % 5 == 0:
            roles.append("user")
        turns += [(conv, turn, role, f"{conv}.{turn}") for turn, role in enumerate(roles)]
    turns += [(99, turn, "user" if turn % 2 == 0 else "assistant", f"hot.{turn}") for turn in range(300)]
    pick.shuffle(turns)
    return turns


TURNS = make_turns()


def by_conversation():
    groups = {}
    for row in sorted(TURNS):
        groups.setdefault(row[0], []).append(row)
    return groups


@pytest.fixture
def turns(spark):
    return spark.createDataFrame(TURNS, SCHEMA)


@pytest.fixture(autouse=True)
def short_segments(monkeypatch):
    monkeypatch.setattr(conversations, "TURNS_PER_SEGMENT", 7)


def admitted(rows, cap):
    """The chat loop: the limit is tested before a user turn, which brings its answer."""
    kept = []
    for i, row in enumerate(rows):
        after_user = bool(kept) and kept[-1][2] == "user" and len(kept) == cap and row[2] == "assistant"
        if len(kept) < cap or (after_user and i == cap):
            kept.append(row)
        else:
            break
    return kept


def rows_of(frame):
    return sorted(tuple(row) for row in frame.collect())


@pytest.mark.parametrize("cap", [1, CAP, 20])
def test_admitted_turns(turns, cap, plan):
    frame = conversations.admitted_turns(turns, cap)
    assert rows_of(frame) == sorted(row for rows in by_conversation().values() for row in admitted(rows, cap))
    text = plan(frame)
    assert text.count("WindowGroupLimit") >= 2 and text.count("Exchange") <= 4


@pytest.mark.parametrize("length,kept", [(19, 19), (20, 20), (21, 20), (22, 20)])
def test_cap_of_twenty(spark, length, kept):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", "x") for t in range(length)]
    assert conversations.admitted_turns(spark.createDataFrame(rows, SCHEMA)).count() == kept


def test_user_turn_that_fills_the_cap_is_answered(spark):
    roles = ["system", *["user", "assistant"] * 12]
    rows = [(1, t, role, "x") for t, role in enumerate(roles)]
    assert conversations.admitted_turns(spark.createDataFrame(rows, SCHEMA)).count() == 21


def test_sizes_and_visible(turns):
    sizes = {r.conv_id: (r.messages, r.at_cap) for r in conversations.conversation_sizes(turns, CAP).collect()}
    assert sizes == {c: (len(rows), len(rows) >= CAP) for c, rows in by_conversation().items()}
    assert rows_of(conversations.visible_turns(turns)) == sorted(r for r in TURNS if r[2] != "system")


def test_history_pairs(turns):
    expected = []
    for conv, rows in by_conversation().items():
        shown = [row for row in rows if row[2] != "system"]
        expected += [
            (conv, a[1], a[3], b[3]) for a, b in zip(shown, shown[1:]) if (a[2], b[2]) == ("user", "assistant")
        ]
    assert rows_of(conversations.history_pairs(turns)) == sorted(expected)


def test_turn_and_paired_history(turns):
    before, paired = {}, {}
    for conv, rows in by_conversation().items():
        kept = sorted(rows, key=lambda row: row[1])
        shown = [row for row in kept if row[2] != "system"]
        for i, row in enumerate(kept):
            if row[2] == "user":
                before[conv, row[1]] = [(r[2], r[3]) for r in kept[:i]]
        for i, row in enumerate(shown):
            if row[2] == "user":
                pairs = [(a, b) for a, b in zip(shown[:i], shown[1:]) if (a[2], b[2]) == ("user", "assistant")]
                paired[conv, row[1]] = [m for a, b in pairs for m in (("human", a[3]), ("ai", b[3]))]
    for found, expected in (
        (conversations.turn_history(turns), before),
        (conversations.paired_history(turns), paired),
    ):
        assert {(r.conv_id, r.turn): [tuple(m) for m in r.history] for r in found.collect()} == expected


def test_long_conversations_lose_nothing(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"m{t}") for t in range(50)]
    turns = spark.createDataFrame(rows, SCHEMA)
    none = spark.createDataFrame([], "conv_id long, position int, text string")
    assert [len(r.history) for r in conversations.turn_history(turns).orderBy("turn").collect()] == list(range(0, 50, 2))
    assert [len(r.history) for r in conversations.paired_history(turns).orderBy("turn").collect()] == list(range(0, 50, 2))
    text = conversations.feedback_text(turns, conversations.documents_context(none)).first().text
    assert text == "\n\n" + "\n".join(f"m{t}" for t in range(50))


def test_closed_conversations(turns):
    failed = F.col("turn") % 11 == 9
    expected = []
    for rows in by_conversation().values():
        for row in rows:
            expected.append(row)
            if row[1] % 11 == 9:
                break
    assert rows_of(conversations.closed_conversations(turns, failed)) == sorted(expected)


def test_chat_segments(spark):
    pick = random.Random(4)
    events = [(pick.choice([1, 1, 1, 2, None]), f"2024-01-0{pick.randint(1, 3)} {pick.randint(0, 23):02}:00:00", i, pick.random() < 0.2) for i in range(300)]
    frame = spark.createDataFrame(events, "user long, at string, n int, reset boolean").withColumn("at", F.col("at").cast("timestamp"))
    numbered = conversations.chat_segments(frame, "user", "at", F.col("reset"), ["at", "n"])
    counts, expected = {}, {}
    for user, at, n, reset in sorted(events, key=lambda e: (e[1], e[2])):
        counts[user] = counts.get(user, 0) + reset
        expected[n] = counts[user]
    assert {row.n: row.segment for row in numbered.collect()} == expected


def test_contexts_seeds_and_feedback(spark):
    documents = spark.createDataFrame(
        [(1, 10, "B"), (1, 2, "A"), (2, 0, "only"), (3, 0, "x")], "conv_id long, position int, text string"
    )
    contexts = conversations.documents_context(documents)
    found = {r.conv_id: (r.plain, r.lines, r.numbered) for r in contexts.collect()}
    assert found[1] == ("A\n\nB", "A\nB", "Document 1:\nA\n\nDocument 2:\nB")
    turns = spark.createDataFrame(
        [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (3, 0, "system", "kept"), (4, 0, "user", "alone")], SCHEMA
    )
    seeded = rows_of(conversations.seeded_turns(turns, contexts, ("<", ">")))
    assert [row for row in seeded if row[1] == -1] == [(1, -1, "system", "<A\n\nB>"), (2, -1, "system", "<only>")]
    assert len(seeded) == 6
    texts = {r.conv_id: r.text for r in conversations.feedback_text(turns, contexts).collect()}
    assert texts == {1: "A\nB\n\nhi\nyes", 2: "only\n\n", 3: "x\n\nkept", 4: "\n\nalone"}


def test_seeded_turns_can_be_used_further(spark, turns, plan):
    """The union's sides share a partitioning here, which must not be relied on."""
    documents = spark.createDataFrame(
        [(conv, 0, f"doc {conv}") for conv in range(1, 30, 2)], "conv_id long, position int, text string"
    )
    contexts = conversations.documents_context(documents)
    seeded = conversations.seeded_turns(conversations.admitted_turns(turns, CAP), contexts, ("<", ">"))
    histories = conversations.turn_history(seeded)
    union = plan(seeded)
    assert "Coalesce" in union and union.count("Exchange") == plan(histories).count("Exchange") - 2
    with_system = {row[0] for row in TURNS if row[2] == "system"}
    expected = {}
    for conv, rows in by_conversation().items():
        kept = admitted(rows, CAP)
        if conv % 2 and conv < 30 and conv not in with_system:
            kept = [(conv, -1, "system", f"<doc {conv}>"), *kept]
        for i, row in enumerate(kept):
            if row[2] == "user":
                expected[conv, row[1]] = [(r[2], r[3]) for r in kept[:i]]
    found = {(r.conv_id, r.turn): [tuple(m) for m in r.history] for r in histories.collect()}
    assert found == expected
