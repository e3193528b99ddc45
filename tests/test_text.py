import hashlib
import os
import re
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.functions import text as texts

SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0         　"
SAMPLES = [
    "",
    " ",
    "one",
    "  two words ",
    "a b　c",
    "x​y",
    "tail\n\n",
    SPACES,
    "é" + SPACES + "😀" + SPACES,
]


def values(spark, rows, column):
    frame = spark.createDataFrame(list(enumerate(rows)), "i int, value string")
    return [row[0] for row in frame.orderBy("i").select(column(F.col("value"))).collect()]


def test_words_and_strip_agree_with_python(spark):
    assert values(spark, SAMPLES, texts.word_count) == [len(s.split()) for s in SAMPLES]
    assert values(spark, SAMPLES, texts.strip) == [s.strip() for s in SAMPLES]


def test_every_space_character_is_known(spark):
    every = [chr(i) for i in range(0x3100) if chr(i).isspace()]
    assert values(spark, [f"a{c}b" for c in every], texts.word_count) == [2] * len(every)


def test_names(spark):
    paths = ["/a/b/c.pdf", "c.PDF", "/a/", "/a/no_extension", "/x/y.tar.gz"]
    assert values(spark, paths, texts.file_name) == [os.path.basename(p) for p in paths]
    names = ["a.pdf", "a", "a.b.c", ".hidden", "..x", "a.", "", "_1.pdf", "x_1.tar.gz", "..a.b"]
    stems = values(spark, names, lambda c: texts.split_extension(c)[0])
    extensions = values(spark, names, lambda c: texts.split_extension(c)[1])
    assert list(zip(stems, extensions)) == [os.path.splitext(n) for n in names]
    assert values(spark, names, texts.last_dot_part) == [n.split(".")[-1] for n in names]
    suffixed = ["a.pdf", "A.PDF", "a.pdf.txt", "pdf", ".pDf"]
    assert values(spark, suffixed, texts.has_document_suffix) == [
        n.lower().endswith(".pdf") for n in suffixed
    ]


def test_document_uuid(spark):
    known = "123e4567-e89b-12d3-a456-426614174000"
    paths = [f"/in/{known}.pdf", f"/in/x_{known.upper()}_{known}.pdf", f"/{known}/plain.pdf", "/in/plain.pdf"]
    version = F.lit(datetime(2024, 1, 1))
    found = values(spark, paths, lambda c: texts.document_uuid(c, version))
    assert found[:2] == [known, known.upper()]
    shape = re.compile(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}")
    assert all(shape.fullmatch(one) for one in found[2:]) and found[2] != found[3]
    assert found == values(spark, paths, lambda c: texts.document_uuid(c, version))
    later = values(spark, paths, lambda c: texts.document_uuid(c, F.lit(datetime(2024, 1, 2))))
    assert later[:2] == found[:2] and later[3] != found[3]


def test_expiry_is_a_day_later(spark):
    row = spark.range(1).select(
        (texts.expiry(texts.as_timestamp("2024-02-28 23:30:00"))).cast("string").alias("t")
    ).first()
    assert row.t == "2024-02-29 23:30:00"


OUTPUTS = [
    " plain ",
    "<think>a\nb</think> x <think>c</think>y",
    "Thought: t\nmore Observation: o",
    "Action: a\nAction Input: b\nObservation: c",
    "Action: a Observation: b Action Input: c Observation: d",
    "<think>open",
    "Thought: Action: x Action Input: y Observation: z Observation: w",
    " 　kept ",
]


def python_clean(output):
    output = "No response generated" if output is None else output
    for pattern in (
        r"<think>.*?</think>",
        r"Thought:.*?Observation:",
        r"Action:.*?Action Input:.*?Observation:",
    ):
        output = re.sub(pattern, "", output, flags=re.DOTALL)
    return output.strip()


def test_clean_response(spark):
    outputs = [*OUTPUTS, None]
    cleaned = values(spark, outputs, texts.clean_response)
    assert cleaned == [python_clean(output) for output in outputs]
    assert values(spark, cleaned[:1], texts.clean_response) == cleaned[:1]


@pytest.mark.parametrize("moment", ["2024-05-01 12:00:00", datetime(2024, 5, 1, 12)])
def test_as_timestamp(spark, moment):
    row = spark.range(1).select(texts.as_timestamp(moment).cast("string").alias("t")).first()
    assert row.t == "2024-05-01 12:00:00"


def test_words_are_runs_of_letters_and_digits():
    """As the pattern says for every character, without a pattern."""
    from paperloom.operators.embedding import words_of

    pattern = re.compile(r"[^\W_]+")
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x11000), 0x1D7D8, 0x1F600, 0x20000]))
    for text in ("", "_a_b", "\u0130stanbul \u00df\u2170", every, " ".join(f"{c}a" for c in every)):
        assert words_of(text) == pattern.findall(text.lower())


def test_words_are_cut_and_counted_as_whole_arrays(monkeypatch):
    """Other letters than ASCII, lower case that is longer, texts without words, slices."""
    from paperloom.operators import embedding

    words_of, embedder = embedding.words_of, embedding.HashedEmbedder(8)
    given = [None, "", "\n", " a", "b\n", "The thé THE", "İx ΑΣ ΑΣ, ½x² 4³", "𝟘𐐀 𝟘𐐀", "x" * 50, "end"]
    expected = []
    for text in given:
        buckets = [int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % 8 for word in words_of(text or "")]
        expected.append(np.bincount(buckets, minlength=8).tolist())
    monkeypatch.setattr(embedding, "words_of", None)
    for size in (1, 20, 1 << 22):
        monkeypatch.setattr(embedding, "_CHARACTERS_AT_ONCE", size)
        assert embedder(given).tolist() == expected
    rows, numbers, words = embedding._numbered_words(["", "a é a", "", "é"])
    assert rows.tolist() == [1, 1, 1, 3] and words[numbers].tolist() == ["a", "é", "a", "é"]
    assert embedder([]).shape == (0, 8)
