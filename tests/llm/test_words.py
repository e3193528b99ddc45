"""Hashes of words: equal for equal words, wherever they lie."""

import random
import re

import numpy as np

from paperloom.llm import words


def test_words_are_what_white_space_parts(monkeypatch):
    draw = random.Random(4)
    parts = list("abAB.é漢\x1c\x85 ") + [" ", "\n", "\t", "\x0b", "\r\n", "xy" * 40]
    for piece in (3, 17, 1 << 19):
        monkeypatch.setattr(words, "_PIECE", piece)
        texts = [None, ""] + ["".join(draw.choices(parts, k=draw.randrange(60))) for _ in range(300)]
        hashes, offsets = words.word_hashes(texts)
        names = {}
        for text, a, b in zip(texts, offsets[:-1], offsets[1:]):
            lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
            own = re.findall(r"[^\x20\x09-\x0D]+", lowered)
            assert len(own) == b - a
            for word, value in zip(own, hashes[a:b].tolist()):
                assert names.setdefault(word, value) == value
        assert len(set(names.values())) == len(names)
        assert offsets[0] == 0 and offsets[-1] == len(hashes)
    assert words.word_hashes([])[0].size == 0 and words.word_hashes([]) [1].tolist() == [0]


def test_hashes_are_spread():
    """Words alike but for their ends, and those of the same letters, differ in all bits."""
    draw = random.Random(1)
    some = sorted({"".join(draw.choices("abcdefgh", k=draw.randrange(1, 9))) for _ in range(200_000)})
    hashes = words.word_hashes([" ".join(some)])[0]
    assert len(np.unique(hashes)) == len(some)
    for shift in (0, 16, 32, 48):
        counts = np.bincount(((hashes >> np.uint64(shift)) & np.uint64(255)).astype(int), minlength=256)
        mean = len(some) / 256
        assert abs(counts - mean).max() < 6 * np.sqrt(mean)
    assert words.word_hashes(["x" * 10**6 + " y"])[1].tolist() == [0, 2]
