"""Words of texts as 64-bit hashes, in arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SLICE_CHARS = 4_000_000
# Bytes that are looked at together; each takes some 40 bytes meanwhile.
_PIECE = 1 << 19

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def text_slices(texts: list[str | None], chars: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about ``chars`` characters; a longer text is one run."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= chars:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit value for each byte, A-Z as a-z, and one for each place in a word."""
    draw = np.random.default_rng(20_240_501)
    values = draw.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    values[65:91] = values[97:123]
    return values, _powers(64)


def _powers(count: int) -> np.ndarray:
    base = np.full(count, 0x9E6C63D0876A9A35, np.uint64)
    base[0] = 1
    return np.cumprod(base)


_VALUES, _POWERS = _tables()
_BYTES = np.random.default_rng(20_240_502).integers(0, 1 << 63, 256, np.uint64) * np.uint64(
    2
) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places of the first bytes) of the words in some bytes: the sum of the bytes'
    values times odd factors by place, scrambled with the length."""
    letters = np.flatnonzero(~_SPACE[data])
    if not len(letters):
        return np.zeros(0, np.uint64), letters
    first = np.flatnonzero(np.diff(letters, prepend=-2) != 1)
    size = np.diff(first, append=len(letters))
    place = np.arange(len(letters)) - np.repeat(first, size)
    longest = int(size.max())
    powers = _POWERS if longest <= len(_POWERS) else _powers(longest)
    sums = np.add.reduceat(_VALUES[data[letters]] * powers[place], first)
    return mixed(sums ^ mixed(size.astype(np.uint64))), letters[first]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, offsets of texts): A-Z lower-cased, words are what ASCII
    white space parts, which is also what bytes are split by. Null is empty."""
    plain = [(text or "").encode("utf-8", "replace") for text in texts]
    data = np.frombuffer(b" ".join(plain), np.uint8)
    begins = np.cumsum([0, *(len(x) + 1 for x in plain)])
    found, places, at = [], [], 0
    while at < len(data):
        end = at + _PIECE
        if end < len(data):  # a piece ends where a word does
            gap = np.flatnonzero(_SPACE[data[end : end + _PIECE]])
            while not len(gap) and end < len(data):
                end += _PIECE
                gap = np.flatnonzero(_SPACE[data[end : end + _PIECE]])
            end += int(gap[0]) if len(gap) else 0
        hashes, first = _hashes(data[at:end])
        found.append(hashes)
        places.append(first + at)
        at = end
    whole = np.concatenate([np.zeros(0, np.uint64), *found])
    where = np.concatenate([np.zeros(0, np.int64), *places])
    return whole, np.searchsorted(where, begins)


def run_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hashes of the runs of bytes that begin at ``starts``, the first at 0; each byte
    counts as it is. No run is empty."""
    ends = np.append(starts[1:], len(data))
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        last = max(int(np.searchsorted(ends, starts[first] + _PIECE, "right")), first + 1)
        size = ends[first:last] - starts[first:last]
        begins = starts[first:last] - starts[first]
        part = data[starts[first] : ends[last - 1]]
        place = np.arange(len(part)) - np.repeat(begins, size)
        longest = int(size.max())
        powers = _POWERS if longest <= len(_POWERS) else _powers(longest)
        sums = np.add.reduceat(_BYTES[part] * powers[place], begins)
        out[first:last] = mixed(sums ^ mixed(size.astype(np.uint64)))
        first = last
    return out


def chained(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` values in a row; shorter than the input by width - 1."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = mixed(out + hashes[k : k + n])
    return out


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Distinct shingles of one text's words, sorted; fewer words than ``width`` are one
    shingle, none have none."""
    if not len(hashes):
        return hashes
    return np.unique(chained(hashes, min(width, len(hashes))))
