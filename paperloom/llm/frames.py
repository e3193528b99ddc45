"""Texts as seekable compressed frames.

A text is cut into frames of a fixed number of units (code points); each is compressed
by itself, and the units before it are kept with it. A range of units is read from the
frames that hold it alone: the frames at its cuts are decompressed and cut, those
between pass on whole, one after another. So a text is never held as one string, and
a long one costs a reader of a few units no more than a short one does.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import zstandard

from paperloom.llm.common import kept_in_worker

UNITS = 16_384
LEVEL = 1


def _opener() -> zstandard.ZstdDecompressor:
    return kept_in_worker(("frames opened",), zstandard.ZstdDecompressor)


def _packer(level: int) -> zstandard.ZstdCompressor:
    make = lambda: zstandard.ZstdCompressor(level=level)
    return kept_in_worker(("frames packed", level), make)


class Frames:
    """The frames of one text: ``starts[k]`` units lie before frame k."""

    __slots__ = ("starts", "units", "frames")

    def __init__(self, starts: list[int], units: int, frames: list[bytes]):
        self.starts, self.units, self.frames = starts, units, frames

    def read(self, first: int, last: int) -> Iterator[bytes]:
        """UTF-8 bytes of the units from ``first`` up to, not including, ``last``."""
        first, last = max(first, 0), min(last, self.units)
        if first >= last:
            return
        opened = _opener()
        k = bisect_right(self.starts, first) - 1
        while k < len(self.frames) and self.starts[k] < last:
            start = self.starts[k]
            end = self.starts[k + 1] if k + 1 < len(self.frames) else self.units
            plain = opened.decompress(self.frames[k])
            if first > start or last < end:
                units = plain.decode()
                plain = units[max(first - start, 0) : last - start].encode()
            yield plain
            k += 1

    def holds_any(self, marks: tuple[bytes, ...]) -> bool:
        """Whether any mark occurs, across the ends of frames too."""
        longest = max(map(len, marks))
        tail = b""
        for plain in self.read(0, self.units):
            joined = tail + plain
            if any(mark in joined for mark in marks):
                return True
            tail = joined[1 - longest :] if longest > 1 else b""
        return False


class FrameWriter:
    """Frames of units that come in pieces."""

    def __init__(self, units: int = UNITS, level: int = LEVEL):
        self.size, self.packer = units, _packer(level)
        self.starts: list[int] = []
        self.frames: list[bytes] = []
        self.units = 0
        self.pending = ""

    def add(self, text: str) -> None:
        self.pending += text
        at = 0
        while len(self.pending) - at >= self.size:
            self._frame(self.pending[at : at + self.size])
            at += self.size
        self.pending = self.pending[at:]

    def _frame(self, text: str) -> None:
        self.starts.append(self.units)
        self.frames.append(self.packer.compress(text.encode()))
        self.units += len(text)

    def done(self) -> Frames:
        if self.pending:
            self._frame(self.pending)
            self.pending = ""
        return Frames(self.starts, self.units, self.frames)


def packed(text: str | None, units: int = UNITS, level: int = LEVEL) -> Frames:
    """The frames of a text; null has none."""
    writer = FrameWriter(units, level)
    for at in range(0, len(text or ""), units):
        writer.add((text or "")[at : at + units])
    return writer.done()


def digest(pieces: Iterable[bytes]) -> str:
    """Lowercase hex of the SHA-256 of pieces in a row, one held at a time."""
    running = hashlib.sha256()
    for piece in pieces:
        running.update(piece)
    return running.hexdigest()
