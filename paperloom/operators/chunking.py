"""Cutting texts into overlapping chunks."""

from __future__ import annotations

import traceback
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom import fixed_values as fixed
from paperloom.functions.text import as_timestamp

# Characters of chunks that a task holds before it passes them on, and rows.
_CHARACTERS_PER_OUTPUT = 1 << 20
_ROWS_PER_OUTPUT = 4096


def fixed_chunks(
    documents: DataFrame,
    size: int = fixed.CHUNK_SIZE,
    overlap: int = fixed.CHUNK_OVERLAP,
    text: str = "text",
) -> DataFrame:
    """Windows of ``size`` characters, each starting ``size - overlap`` after the last.

    Adds ``chunk_index`` and ``chunk_text`` in place of the text. Runs in the JVM
    without a shuffle. Finding a character position means reading the text up to
    it, so one pass first cuts the text into pieces of one stride; windows are
    then put together from neighbouring pieces, in time linear in the text.
    """
    stride = _stride(size, overlap)
    spanned = -(-size // stride)
    keep = [name for name in documents.columns if name != text]
    count = F.ceil((F.length(text) - overlap) / F.lit(stride)).cast("int")
    pieces = documents.select(
        *keep,
        F.greatest(count, F.lit(1)).alias("_count"),
        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{stride}}}"), F.lit(0)).alias("_pieces"),
    )
    windows = F.transform(
        F.col("_pieces"),
        lambda _, i: F.substring(
            F.concat_ws("", *[F.get("_pieces", i + ahead) for ahead in range(spanned)]), 1, size
        ),
    )
    return (
        pieces.select(*keep, "_count", F.posexplode(windows).alias("chunk_index", "chunk_text"))
        .filter(F.col("chunk_index") < F.col("_count"))
        .select(*keep, "chunk_index", "chunk_text")
    )


def fixed_count(
    documents: DataFrame,
    size: int = fixed.CHUNK_SIZE,
    overlap: int = fixed.CHUNK_OVERLAP,
    text: str = "text",
) -> int:
    """How many windows :func:`fixed_chunks` makes, from the lengths of the texts."""
    count = F.greatest(F.ceil((F.length(text) - overlap) / F.lit(_stride(size, overlap))), F.lit(1))
    # An empty text has no window.
    total = documents.filter(F.length(text) > 0).agg(F.sum(count).alias("total")).head()
    return int(total["total"] or 0)


def _stride(size: int, overlap: int) -> int:
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    return size - overlap


class RecursiveSplitter:
    """Cuts one text at the coarsest separator that occurs in it.

    A separator stays at the start of the piece it opens. Neighbouring pieces
    shorter than ``size`` are packed into chunks of at most ``size`` characters,
    and the tail of a chunk, at most ``overlap`` long, opens the next one. A
    piece of ``size`` or more is cut by the finer separators instead, and nothing
    is carried over across it. Chunks lose outer white space; empty ones are left
    out. Positions in the text stand for the pieces, so no piece is copied.
    """

    def __init__(
        self,
        size: int = fixed.CHUNK_SIZE,
        overlap: int = fixed.CHUNK_OVERLAP,
        separators: list[str] | None = None,
    ) -> None:
        _stride(size, overlap)
        self.size = size
        self.overlap = overlap
        self.separators = fixed.SEPARATORS if separators is None else separators

    def __call__(self, text: str) -> list[str]:
        stripped = (text[a:b].strip() for a, b in self.spans(text, 0, len(text), 0))
        return [chunk for chunk in stripped if chunk]

    def spans(self, text: str, start: int, end: int, level: int) -> Iterator[tuple[int, int]]:
        """(start, end) of every chunk of ``text[start:end]``, before stripping."""
        while level < len(self.separators):
            separator = self.separators[level]
            if separator == "" or text.find(separator, start, end) >= 0:
                break
            level += 1
        if level == len(self.separators):
            if end > start:
                yield start, end
            return
        if separator == "":
            yield from self._windows(start, end)
            return

        # Cut positions of the short pieces that make up the chunk being packed.
        cuts = deque([start])
        for piece_end in self._cuts(text, separator, start, end):
            piece_start = cuts[-1]
            fits = piece_end - cuts[0] <= self.size
            long = piece_end - piece_start >= self.size
            if (long or not fits) and piece_start > cuts[0]:
                yield cuts[0], piece_start
            if long:
                yield from self.spans(text, piece_start, piece_end, level + 1)
                cuts = deque([piece_end])
                continue
            while not fits and len(cuts) > 1:
                if piece_start - cuts[0] <= self.overlap and piece_end - cuts[0] <= self.size:
                    break
                cuts.popleft()
            cuts.append(piece_end)
        if cuts[-1] > cuts[0]:
            yield cuts[0], cuts[-1]

    def _windows(self, start: int, end: int) -> Iterator[tuple[int, int]]:
        """Single characters packed: windows at a fixed stride."""
        stride = self.size - self.overlap
        while start + self.size < end:
            yield start, start + self.size
            start += stride
        if start < end:
            yield start, end

    @staticmethod
    def _cuts(text: str, separator: str, start: int, end: int) -> Iterator[int]:
        """End positions of the non-empty pieces, in order."""
        width = len(separator)
        found = text.find(separator, start, end)
        while found >= 0:
            if found > start:
                yield found
            start = found
            found = text.find(separator, found + width, end)
        if end > start:
            yield end


def recursive_chunks(
    documents: DataFrame,
    keys: list[str],
    text: str = "text",
    splitter: Callable[[str], list[str]] | None = None,
) -> DataFrame:
    """One row per chunk: the keys, ``chunk_index``, ``chunk_text`` and ``error``.

    Rows are cut where they are read: no shuffle. A text that cannot be cut gives
    one row with a null chunk, its message in ``error``, and no chunks.
    """
    cut = splitter or RecursiveSplitter()
    schema = T.StructType(
        [
            *[documents.schema[name] for name in keys],
            T.StructField("chunk_index", T.IntegerType()),
            T.StructField("chunk_text", T.StringType()),
            T.StructField("error", T.StringType()),
        ]
    )

    def chunk_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _chunks_of(batch, keys, text, cut, schema.names)

    return documents.select(*keys, text).mapInArrow(chunk_batches, schema)


def _chunks_of(
    batch: pa.RecordBatch, keys: list[str], text: str, cut: Callable, names: list[str]
) -> Iterator[pa.RecordBatch]:
    """Chunks in batches of bounded size; one text at a time is a Python object."""
    key = batch.select(keys)
    rows: list[tuple] = []
    held = 0
    for at, body in enumerate(batch.column(text)):
        try:
            chunks = cut(body.as_py())
        except Exception as failure:
            rows.append((at, None, None, f"{failure}\n{traceback.format_exc()}"))
            continue
        for i, chunk in enumerate(chunks):
            rows.append((at, i, chunk, None))
            held += len(chunk)
            if len(rows) >= _ROWS_PER_OUTPUT or held >= _CHARACTERS_PER_OUTPUT:
                yield _chunk_batch(key, rows, names)
                rows, held = [], 0
    if rows:
        yield _chunk_batch(key, rows, names)


def register_chunker(
    spark: SparkSession,
    name: str = "recursive_chunks",
    splitter: Callable[[str], list[str]] | None = None,
) -> None:
    """Make the chunker a table function for SQL:
    ``SELECT ... FROM documents, LATERAL recursive_chunks(text)``."""
    cut = splitter or RecursiveSplitter()

    @F.udtf(returnType="chunk_index int, chunk_text string")
    class ChunkText:
        def eval(self, text: str):
            if text is not None:
                yield from enumerate(cut(text))

    spark.udtf.register(name, ChunkText)


def _chunk_batch(keys: pa.RecordBatch, rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    place, index, chunk, error = zip(*rows)
    columns = [
        *keys.take(pa.array(place)).columns,
        pa.array(index, pa.int32()),
        pa.array(chunk, pa.string()),
        pa.array(error, pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=names)


def chunk_rows(chunks: DataFrame, created_at, document_id: str, document_uri: Column) -> DataFrame:
    """Chunks in the shape of the chunk staging table.

    ``processed_for_embedding`` is false: what is pending is decided by the
    embedding table, see ``pending_chunks``.
    """
    return chunks.select(
        F.xxhash64(F.col(document_id), F.col("chunk_index")).alias("id"),
        F.col(document_id).cast("long").alias("document_id"),
        F.col("chunk_index").cast("int").alias("chunk_index"),
        F.col("chunk_text"),
        F.length("chunk_text").cast("int").alias("chunk_size"),
        as_timestamp(created_at).alias("created_at"),
        F.lit(False).alias("processed_for_embedding"),
        document_uri.alias("document_uri"),
    )


def chunk_report(chunks: DataFrame, key: str = "document_id") -> DataFrame:
    """Per document: number of chunks, characters in them, last index.

    Counts are combined before the shuffle; the chunk texts are not moved.
    """
    return chunks.groupBy(key).agg(
        F.count(F.lit(1)).alias("chunks"),
        F.sum(F.length("chunk_text")).alias("characters"),
        F.max("chunk_index").alias("last_index"),
    )


def rebuilt_digest(chunks: DataFrame, key: str = "document_id") -> DataFrame:
    """Per document: chunk count and md5 of its chunks joined without white space.

    For chunks without overlap this equals the digest of the document itself. A
    group holds one document's chunks, no more than the cell they were cut from.
    """
    bare = F.regexp_replace("chunk_text", fixed.WHITESPACE + "+", "")
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", bare.alias("text"))))
    joined = F.array_join(F.transform(parts, lambda part: part["text"]), "")
    return chunks.groupBy(key).agg(
        F.md5(joined).alias("digest"),
        F.length(joined).cast("long").alias("characters"),
    )
