"""Vectors for texts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Embedder = Callable[[list[str]], np.ndarray]

EMBEDDING_DIMENSION = 256
# Characters of texts that are cut into words at a time, with some 30 bytes for each.
_CHARACTERS_AT_ONCE = 1 << 20

# Texts whose vectors are made at a time where they are passed on as bytes.
_TEXTS_AT_ONCE = 2048


class _Buckets(dict):
    """Bucket per word, worked out when a word is first met; the first words are remembered,
    as those met late are mostly rare ones."""

    _remembered = 100_000

    def __init__(self, dimension: int) -> None:
        super().__init__()
        self.dimension = dimension

    def __missing__(self, word: str) -> int:
        digest = hashlib.md5(word.encode("utf-8")).hexdigest()
        bucket = int(digest[:8], 16) % self.dimension
        if len(self) < self._remembered:
            self[word] = bucket
        return bucket

    def __reduce__(self):
        return _Buckets, (self.dimension,)


class HashedEmbedder:
    """Bag of words: word counts in buckets chosen by md5.

    A lexical stand-in for a model: texts are alike when they share words. The
    counts stay whole numbers, so sums over them are exact in any order; the
    cosine metric takes care of their length.
    """

    #: Values are whole numbers, hardly any above 255.
    whole = True

    def __init__(self, dimension: int = EMBEDDING_DIMENSION) -> None:
        self.dimension = dimension
        self._buckets = _Buckets(dimension)

    def __call__(self, texts: list[str]) -> np.ndarray:
        ends = np.cumsum([len(text or "") for text in texts])
        vectors = np.zeros((len(texts), self.dimension), dtype=np.float32)
        start = 0
        while start < len(texts):
            least = (ends[start - 1] if start else 0) + _CHARACTERS_AT_ONCE
            end = max(int(np.searchsorted(ends, least, side="right")), start + 1)
            lowered = [(text or "").lower() for text in texts[start:end]]
            rows, numbers, words = _numbered_words(lowered)
            own = np.fromiter(map(self._buckets.__getitem__, words), np.int64, len(words))
            counts = np.bincount(
                rows * self.dimension + own[numbers], minlength=(end - start) * self.dimension
            )
            vectors[start:end] = counts.reshape(end - start, self.dimension)
            start = end
        return vectors


class _LettersAndDigits:
    """Which characters, by their codes, are letters or digits, as far as they are met."""

    def __init__(self) -> None:
        self.known = np.zeros(0, np.bool_)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        most = int(codes.max(initial=0))
        if most >= len(self.known):
            size = min(max(1 << most.bit_length(), 4096), 0x110000)
            self.known = np.fromiter((chr(code).isalnum() for code in range(size)), np.bool_, size)
        return self.known[codes]

    def __reduce__(self):
        return _LettersAndDigits, ()


_LETTERS_AND_DIGITS = _LettersAndDigits()


def numbered_words(lowered: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The words of lower-case texts, as :func:`words_of` finds them: the row of each, its
    number, and the different words in the order of their numbers.

    Words are cut and told apart as whole arrays; none becomes a Python string."""
    codes = np.frombuffer("\n".join(lowered).encode("utf-32-le"), np.uint32)
    inside = np.concatenate([[False], _LETTERS_AND_DIGITS(codes), [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts = edges[::2]
    of_words = codes[inside[1:-1]]
    written = of_words.tobytes().decode("utf-32-le").encode("utf-8")
    lengths = edges[1::2] - starts
    limits = np.concatenate([[0], np.cumsum(lengths)])
    if len(written) > len(of_words):
        # Bytes of each character.
        widths = np.ones(len(of_words), np.uint8)
        for code in (0x80, 0x800, 0x10000):
            widths += of_words >= code
        limits = np.concatenate([[0], np.cumsum(widths, dtype=np.int32)])[limits]
    column = pa.StringArray.from_buffers(
        len(starts), pa.py_buffer(limits.astype(np.int32)), pa.py_buffer(written)
    ).dictionary_encode()
    firsts = np.cumsum([0, *(len(text) + 1 for text in lowered)])
    rows = np.repeat(np.arange(len(lowered)), np.diff(np.searchsorted(starts, firsts)))
    return rows, column.indices.to_numpy(), column.dictionary


def _numbered_words(lowered: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same with the words as Python strings."""
    rows, numbers, words = numbered_words(lowered)
    return rows, numbers, words.to_numpy(zero_copy_only=False)


class _Blanks(dict):
    """A blank for every character that is no letter or digit, as they are first met."""

    def __missing__(self, code: int) -> int:
        self[code] = code if chr(code).isalnum() else ord(" ")
        return self[code]


_BLANKS = _Blanks()


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters and digits."""
    return text.lower().translate(_BLANKS).split()


def embed(
    rows: DataFrame, text: str, embedder: Embedder | None = None, out: str = "embedding"
) -> DataFrame:
    """Add the vector of a text column, ``embedder`` called once per Arrow batch.

    ``embedder`` takes a list of texts and returns a matrix with one row each.
    No shuffle.
    """
    embedder = embedder or HashedEmbedder()
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])

    def add_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = embedder(batch.column(text).to_pylist())
            names = [*batch.schema.names, out]
            yield pa.RecordBatch.from_arrays([*batch.columns, as_lists(vectors)], names=names)

    return rows.mapInArrow(add_vectors, schema)


def embed_packed(
    rows: DataFrame, text: str, embedder: Embedder | None = None, out: str = "packed"
) -> DataFrame:
    """Put the vector of a text column in its place, as bytes (:func:`packed_vectors`), with
    ``embedder`` called for some thousand texts at a time. No shuffle."""
    embedder = embedder or HashedEmbedder()
    kept = [name for name in rows.columns if name != text]
    fields = [rows.schema[name] for name in kept]
    schema = T.StructType([*fields, T.StructField(out, T.BinaryType())])

    def add_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _TEXTS_AT_ONCE):
                part = batch.slice(start, _TEXTS_AT_ONCE)
                vectors = np.asarray(embedder(part.column(text).to_pylist()))
                columns = [*(part.column(name) for name in kept), packed_vectors(vectors)]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, out])

    return rows.mapInArrow(add_vectors, schema)


def packed_width(first: bytes) -> int:
    """Number of values of a vector of :func:`packed_vectors`."""
    return (len(first) - 1) // first[0]


def packed_vectors(vectors: np.ndarray) -> pa.BinaryArray:
    """Vectors in single precision as bytes: a one and a byte for each value where all are
    whole numbers below 256, else a four and four bytes for each."""
    vectors = np.ascontiguousarray(vectors, "<f4")
    count, width = vectors.shape
    with np.errstate(invalid="ignore"):
        small = ((vectors >= 0) & (vectors < 256) & (vectors == np.rint(vectors))).all(axis=1)
    sizes = np.where(small, width, 4 * width) + 1
    limits = np.concatenate([[0], np.cumsum(sizes)])
    if limits[-1] >= 1 << 31:
        half = count // 2
        return pa.concat_arrays([packed_vectors(vectors[:half]), packed_vectors(vectors[half:])])
    data = np.empty(limits[-1], np.uint8)
    data[limits[:-1]] = np.where(small, 1, 4)
    for kind, chosen in ((np.uint8, np.flatnonzero(small)), ("<f4", np.flatnonzero(~small))):
        if not len(chosen):
            continue
        size = width * np.dtype(kind).itemsize
        written = vectors[chosen].astype(kind).view(np.uint8).reshape(len(chosen), size)
        if len(chosen) == count:
            data.reshape(count, size + 1)[:, 1:] = written
        else:
            data[limits[chosen][:, None] + 1 + np.arange(size)] = written
    buffers = [None, pa.py_buffer(limits.astype("<i4")), pa.py_buffer(data)]
    return pa.Array.from_buffers(pa.binary(), count, buffers)


def unpacked_vectors(column: pa.Array, width: int) -> np.ndarray:
    """What :func:`packed_vectors` was given, as one matrix."""
    if column.null_count:
        raise ValueError("a vector is missing; filter such rows first")
    if not len(column):
        return np.zeros((0, width), np.float32)
    limits = np.frombuffer(column.buffers()[1], "<i4")[column.offset :][: len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)
    vectors = np.empty((len(column), width), np.float32)
    kinds = data[limits[:-1]]
    if not (np.diff(limits) == kinds.astype(np.int64) * width + 1).all():
        raise ValueError(f"vectors must all have {width} values")
    for kind, chosen in (("u1", np.flatnonzero(kinds == 1)), ("<f4", np.flatnonzero(kinds == 4))):
        size = width * np.dtype(kind).itemsize
        if len(chosen) == len(column):
            vectors[:] = data[limits[0] : limits[-1]].reshape(-1, size + 1)[:, 1:].copy().view(kind)
        elif len(chosen):
            places = limits[chosen][:, None] + 1 + np.arange(size)
            vectors[chosen] = data[places].view(kind)
    return vectors


def as_lists(vectors: np.ndarray) -> pa.ListArray:
    count, width = vectors.shape
    offsets = pa.array(np.arange(count + 1, dtype=np.int32) * width)
    return pa.ListArray.from_arrays(offsets, pa.array(vectors.astype(np.float32).ravel()))


def as_matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Vectors of an Arrow list column as one matrix, without a Python object per row."""
    if column.null_count:
        raise ValueError("a vector is missing; filter such rows first")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(column) == 0:
        return flat.reshape(0, width or 0)
    width = width or len(flat) // len(column)
    lengths = np.diff(column.offsets.to_numpy())
    if not (lengths == width).all():
        raise ValueError(f"vectors must all have {width} values")
    return flat.reshape(len(column), width)


def vector_entries(embedded: DataFrame, keys: list[str]) -> DataFrame:
    """Non-zero values of each vector with their bucket, and as parts of a unit vector."""
    squares = F.aggregate(
        "embedding",
        F.lit(0.0),
        lambda total, value: total + value.cast("double") * value.cast("double"),
    )
    # The norm is worked out per vector, below the step that spreads its entries.
    return (
        embedded.select(*keys, F.sqrt(squares).alias("_norm"), "embedding")
        .select(*keys, "_norm", F.posexplode("embedding").alias("bucket", "_value"))
        .filter(F.col("_value") != 0)
        .select(
            *keys,
            F.col("bucket").cast("long").alias("bucket"),
            F.col("_value").cast("double").alias("value"),
            (F.col("_value").cast("double") / F.col("_norm")).alias("unit_value"),
        )
    )
