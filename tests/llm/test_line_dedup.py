"""Line dedup against a plain loop over documents in order."""

import random

from paperloom.llm.line_dedup import remove_repeated_lines

SCHEMA = "doc_id long, text string"


def by_brute_force(rows):
    """(doc_id, text, lines removed, lines) of rows with distinct (id, text)."""
    first, gone = {}, {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        lines = (text or "").split("\n")
        for i in range(len(lines) - 2):
            window = tuple(lines[i : i + 3])
            if "".join(window).strip(" \t\r") == "":
                continue
            if first.setdefault(window, (doc_id, i)) != (doc_id, i):
                gone.setdefault(doc_id, set()).update((i, i + 1, i + 2))
    out = []
    for doc_id, text in rows:
        removed = sorted(gone.get(doc_id, ()))
        lines = (text or "").split("\n")
        if removed:
            text = "\n".join(x for i, x in enumerate(lines) if i not in removed)
        out.append((doc_id, text, removed, 0 if text is None else len(lines)))
    return sorted(out, key=lambda r: r[0])


def found(frame):
    rows = [(r.doc_id, r.text, list(r.lines_removed), r.lines_total) for r in frame.collect()]
    return sorted(rows, key=lambda r: r[0])


def test_random_lines(spark):
    draw = random.Random(1)
    rows = []
    for i in range(300):
        lines = [draw.choice(["a", "b", "c", "", " "]) for _ in range(draw.randrange(9))]
        if i % 3 == 0:  # a passage that a third of the documents share
            lines += ["the", "shared", "passage", "of four"]
        rows.append((i * 3, "\n".join(lines)))
    draw.shuffle(rows)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(remove_repeated_lines(frame)) == by_brute_force(rows)


def test_overlapping_runs_are_merged(spark):
    run = "l1\nl2\nl3\nl4\nl5"
    rows = [(1, f"x\n{run}\ny"), (2, f"{run}\nmine"), (3, "l1\nl2"), (4, "z\nz\nz\nz")]
    got = found(remove_repeated_lines(spark.createDataFrame(rows, SCHEMA)))
    assert got == [
        (1, rows[0][1], [], 7), (2, "mine", [0, 1, 2, 3, 4], 6), (3, "l1\nl2", [], 2),
        (4, "z", [1, 2, 3], 4),
    ]


def test_edge_cases(spark):
    long = "\n".join(f"line {i}" for i in range(30_000))
    rows = [
        (1, None), (2, ""), (3, "\n\n\n\n"), (4, "\n \n\t\n"), (5, long), (6, long + "\nmore"),
        (7, "a\nb\nc"), (7, "a\nb\nc"), (None, "a\nb\nc"), (8, "a\r\nb\r\nc"),
    ]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr(
        "*", "1 as pos", "2 as at", "3 as lines_total", "'k' as _lines", "4 as _window"
    )
    out = remove_repeated_lines(frame)
    assert set(out.columns) == {*frame.columns, "lines_removed"}
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append((r.text, len(r.lines_removed), r.lines_total))
    assert got[1] == [(None, 0, 0)] and got[2] == [("", 0, 1)] and got[3] == [("\n\n\n\n", 0, 5)]
    assert got[4] == [("\n \n\t\n", 0, 4)] and got[5] == [(long, 0, 30_000)]
    assert got[6] == [("more", 30_000, 30_001)]
    assert got[None] == [("a\nb\nc", 0, 3)]  # null ids come first
    assert got[7] == [("", 3, 3)] * 2 and got[8] == [("a\r\nb\r\nc", 0, 3)]
    assert remove_repeated_lines(frame.limit(0)).count() == 0
