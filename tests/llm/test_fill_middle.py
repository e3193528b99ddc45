"""Fill-in-middle: outputs against slices of strings, frames against the whole text."""

import hashlib
import random

from paperloom.llm.fill_middle import Plan, cut_of, draws, output_of, restored, store_frames, transform
from paperloom.llm.frames import Frames, FrameWriter, digest, packed

SCHEMA = "doc_id long, text string"


def text_of(draw, most=200):
    marks = ["<P>", "<S", "M>", "<", ">"] if draw.random() < 0.3 else ["<", "P>"]
    parts = list("aé漢😀\n\x00 ") + marks
    return "".join(draw.choices(parts, k=draw.randrange(most)))


def by_strings(doc_id, text):
    text = text or ""
    n = len(text)
    a, b, c, d = (int(hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or c % 100 >= 90:
        return n, "plain", None, None, text
    first, second = min(a % (n + 1), b % (n + 1)), max(a % (n + 1), b % (n + 1))
    p, m, s = text[:first], text[first:second], text[second:]
    form = "spm" if d % 100 < 20 else "psm"
    return n, form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def test_frames_read_any_range():
    draw = random.Random(1)
    for _ in range(300):
        text = text_of(draw)
        size = draw.randrange(1, 40)
        frames = packed(text, size)
        assert frames.units == len(text) and frames.starts == list(range(0, len(text), size))
        first, last = draw.randrange(-3, 220), draw.randrange(-3, 220)
        assert b"".join(frames.read(first, last)).decode() == text[max(first, 0) : max(last, 0)]
        writer = FrameWriter(size)
        at = 0
        while at < len(text):
            step = draw.randrange(1, 60)
            writer.add(text[at : at + step])
            at += step
        assert writer.done().frames == frames.frames
        marks = (b"<P>", b"<S>", "é漢".encode())
        assert frames.holds_any(marks) == any(m in text.encode() for m in marks)


def test_only_frames_of_a_range_are_opened():
    frames = packed("0123456789" * 100, 100)
    broken = [b"broken"] * 10
    broken[3:5] = frames.frames[3:5]
    assert b"".join(Frames(frames.starts, frames.units, broken).read(350, 451)) == b"0123456789" * 10 + b"0"


def test_outputs_and_back_in_frames_of_any_size():
    draw = random.Random(2)
    forms = set()
    for doc_id in range(400):
        text = text_of(draw)
        plan = Plan(units=draw.randrange(1, 50))
        frames = packed(text, plan.units)
        cut = cut_of(doc_id, frames, plan)
        n, form, _, _, want = by_strings(doc_id, text)
        output = list(output_of(frames, cut))
        assert (cut.form, b"".join(output).decode()) == (form, want)
        assert b"".join(restored(iter(output), form, plan.units)).decode() == text
        whole = want.encode()
        size = draw.randrange(1, 9)  # pieces that end within characters and marks
        pieces = (whole[i : i + size] for i in range(0, len(whole), size))
        assert digest(restored(pieces, form, 5)) == hashlib.sha256(text.encode()).hexdigest()
        forms.add(form)
    assert forms == {"plain", "psm", "spm"}


def test_edge_cases(spark):
    rows = [
        (1, None), (2, ""), (3, "a"), (4, "x<P>y"), (4, "x<P>y"), (None, "null id"), (-5, "mínus"),
        (6, "long é " * 50_000), (7, "a<"), (8, ">b"), (6, "another text"),
    ]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as frames", "2 as units", "3 as n")
    out = transform(store_frames(frame), digests=True)
    got = [tuple(r) for r in out.collect()]
    want = []
    for doc_id, text in rows:
        n, form, p, m, output = by_strings("" if doc_id is None else doc_id, text)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (output, text or "")]
        want.append((doc_id, n, form, p, m, output, *sha))
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert transform(store_frames(frame.limit(0)), digests=True).count() == 0
    assert draws(None, 1) == draws(None, 1) != draws(0, 1)
