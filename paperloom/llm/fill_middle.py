"""Fill-in-middle transformation of texts kept as seekable compressed frames.

A text is cut into prefix, middle and suffix at two places drawn from a digest of its
document's id, and put together as suffix first (spm) or prefix first (psm); some texts
stay plain. Texts are stored once as compressed frames with cumulative unit counts; the
transformation then opens the frames at the cuts to select their units and streams the
others in the order of the output.
"""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.frames import LEVEL, UNITS, Frames, FrameWriter, digest, packed

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARKS = tuple(mark.encode() for mark in (PREFIX, SUFFIX, MIDDLE))

FRAME_TYPE = "array<struct<start:long,frame:binary>>"


class Plan(NamedTuple):
    """``cut``: of a hundred texts, those that are cut. ``suffix_first``: of a hundred cut
    ones, those that become spm. ``units``: code points of a frame."""

    seed: int = 1
    cut: int = 90
    suffix_first: int = 20
    units: int = UNITS
    level: int = LEVEL


class Cut(NamedTuple):
    form: str
    first: int
    second: int


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers of 32 bits, from the id written in decimal (null: nothing)."""
    found = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(found[8 * k : 8 * k + 8], 16) for k in range(4)]


def cut_of(doc_id: int | None, text: Frames, plan: Plan) -> Cut:
    """Form of a text and, unless plain, the units after which prefix and middle end."""
    a, b, c, d = draws(doc_id, plan.seed)
    if not text.units or c % 100 >= plan.cut or text.holds_any(_MARKS):
        return Cut("plain", 0, 0)
    first, second = sorted((a % (text.units + 1), b % (text.units + 1)))
    return Cut("spm" if d % 100 < plan.suffix_first else "psm", first, second)


def output_of(text: Frames, cut: Cut) -> Iterator[bytes]:
    """The transformed text in pieces, frames in the order of the output."""
    if cut.form == "plain":
        yield from text.read(0, text.units)
        return
    prefix = (_MARKS[0], 0, cut.first)
    suffix = (_MARKS[1], cut.second, text.units)
    middle = (_MARKS[2], cut.first, cut.second)
    order = (prefix, suffix, middle) if cut.form == "psm" else (suffix, prefix, middle)
    for mark, first, last in order:
        yield mark
        yield from text.read(first, last)


def restored(output: Iterable[bytes], form: str, units: int = UNITS) -> Iterator[bytes]:
    """The text in pieces, from the pieces of an output and its form alone. Its parts are
    kept as frames until they are in order."""
    if form == "plain":
        yield from output
        return
    parts = {mark: FrameWriter(units) for mark in (PREFIX, SUFFIX, MIDDLE)}
    now: str | None = None
    decoder = codecs.getincrementaldecoder("utf-8")()
    waiting = ""

    def flush(text: str) -> None:
        if text and now is None:
            raise ValueError("an output that does not begin with a mark")
        if text:
            parts[now].add(text)

    for piece in output:
        waiting += decoder.decode(piece)
        while found := [(waiting.index(mark), mark) for mark in parts if mark in waiting]:
            at, mark = min(found)
            flush(waiting[:at])
            now, waiting = mark, waiting[at + len(mark) :]
        # The last characters may be the beginning of a mark.
        flush(waiting[:-2])
        waiting = waiting[-2:]
    flush(waiting)
    for mark in (PREFIX, MIDDLE, SUFFIX):
        part = parts[mark].done()
        yield from part.read(0, part.units)


def store_frames(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    frames: str = "frames",
    units: str = "units",
    plan: Plan = Plan(),
) -> DataFrame:
    """(doc_id, units, frames): every whole text as frames, in the rows' order.

    Null and empty texts have no frames and no units. Repeated rows, null ids and long
    texts are rows like any other; other columns are left out; an empty table gives
    an empty table. No shuffle.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("frame", pa.binary())]))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                packed(one.as_py(), plan.units, plan.level) for one in batch.column("text")
            ]
            cells = [[{"start": s, "frame": f} for s, f in zip(x.starts, x.frames)] for x in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([x.units for x in found], pa.int64()),
                    pa.array(cells, kind),
                ],
                names=["doc_id", units, frames],
            )

    return rows.mapInArrow(pack, f"doc_id long, `{units}` long, `{frames}` {FRAME_TYPE}")


def transform(
    stored: DataFrame,
    plan: Plan = Plan(),
    texts: bool = True,
    digests: bool = False,
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars[, output][, output_sha256,
    restored_sha256]) of every row of :func:`store_frames`.

    n is the text's length in code points; the two lengths are null where the form is
    plain, as it is for empty texts, for texts that hold a mark, and for a share of the
    others. ``texts`` gives the outputs as they are. ``digests`` streams the output into
    its digest, and the text that is rebuilt from output and form into another one,
    without holding either. Rows of a null id draw from the seed alone; repeated rows have
    equal results. Nothing is shuffled.
    """
    fields = [
        ("doc_id", pa.int64()),
        ("n", pa.int64()),
        ("form", pa.string()),
        ("prefix_chars", pa.int64()),
        ("middle_chars", pa.int64()),
    ]
    if texts:
        fields.append(("output", pa.string()))
    if digests:
        fields += [("output_sha256", pa.string()), ("restored_sha256", pa.string())]
    schema = pa.schema(fields)

    def one(doc_id: int | None, units: int, frames: list[dict]) -> tuple:
        text = Frames([x["start"] for x in frames], units, [x["frame"] for x in frames])
        cut = cut_of(doc_id, text, plan)
        plain = cut.form == "plain"
        row = [
            doc_id,
            units,
            cut.form,
            None if plain else cut.first,
            None if plain else cut.second - cut.first,
        ]
        if texts:
            row.append(b"".join(output_of(text, cut)).decode())
        if digests:
            row.append(digest(output_of(text, cut)))
            row.append(digest(restored(output_of(text, cut), cut.form, plan.units)))
        return tuple(row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                one(i.as_py(), n.as_py(), cell.as_py())
                for i, n, cell in zip(*(batch.column(name) for name in ("doc_id", "units", "frames")))
            ]
            columns = list(zip(*rows)) or [[] for _ in schema]
            arrays = [pa.array(list(x), field.type) for x, field in zip(columns, schema)]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    kinds = {pa.int64(): "long", pa.string(): "string"}
    ddl = ", ".join(f"{field.name} {kinds[field.type]}" for field in schema)
    return stored.select("doc_id", "units", "frames").mapInArrow(run, ddl)
