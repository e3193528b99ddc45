"""Token ids in Parquet: written in document order, read selectively.

A row holds a document's ids as a list, and its metadata (number of ids, place of
the first one within its part) as plain columns. Ids are dictionary-encoded or
delta-encoded; row groups and pages are small enough that the page index leads a
reader of few documents to few pages, and readers of metadata touch no ids.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from paperloom.llm.common import blocks_of, kept_in_worker
from paperloom.llm.words import run_hashes, text_slices

SEGMENTS_KEPT = 1_000_000
_LONGEST_KEPT = 64
_IDS_KEPT = 8_000_000
_SLICE_CHARS = 1_000_000
PART_CHARS = 16_000_000
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
ROWS_PER_PAGE = 2_000
PARTS_IN_GROUP = 4_096
#: Offsets of so many parts may be sent to all tasks; beyond, rows are shuffled to them.
PARTS_SENT = 500_000

#: Other white space makes a text one segment: libraries differ in what they count as such.
_OTHER_SPACE = re.compile(r"[^\S \n]").search


class SegmentEncoder:
    """Encodes texts by the library, each distinct segment once while it stays in use.

    A token never goes on from a character that is no white space to a space or line feed,
    nor from a letter to a full stop or comma, so texts are cut there. Segments are looked
    up by hashes, all of a slice at once; new ones go to the library together. Texts with
    the string of a special token go to it whole."""

    def __init__(self, tokenizer_file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        added = self.tokenizer.get_added_tokens_decoder().values()
        marks = [re.escape(token.content) for token in added if token.content]
        self.special = re.compile("|".join(marks)).search if marks else lambda text: None
        self._keep(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<i4"))

    def _keep(self, hashes: np.ndarray, first: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        self.hashes, self.first, self.size, self.ids = hashes, first, size, ids

    def _cuts(self, texts: list[str], data: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Where segments begin: with the texts, white space, and stops after letters."""
        space = (data == 0x20) | (data == 0x0A)
        starts = np.zeros(len(data), bool)
        starts[1:] = space[1:] & ~space[:-1]
        ends = np.ones(len(data), bool)
        ends[:-1] = space[1:]
        ends[begins[1:][begins[1:] > 0] - 1] = True
        small = data | 0x20
        letter = (small >= 0x61) & (small <= 0x7A)
        # Letters from U+00C0 to U+00FF have two bytes; two of them are signs.
        letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        stop = ((data == 0x2E) | (data == 0x2C)) & ends
        starts[1:] |= stop[1:] & letter[:-1]
        for k, text in enumerate(texts):
            if _OTHER_SPACE(text) or self.special(text):
                starts[begins[k] : begins[k + 1]] = False
        starts[begins[:-1][begins[:-1] < len(data)]] = True
        return np.flatnonzero(starts)

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, numbers of ids of the texts)."""
        plain = [text.encode() for text in texts]
        joined = b"".join(plain)
        begins = np.cumsum([0, *map(len, plain)])
        if not joined:
            return np.zeros(0, "<i4"), np.zeros(len(texts), np.int64)
        data = np.frombuffer(joined, np.uint8)
        starts = self._cuts(texts, data, begins)
        keys, at = np.unique(run_hashes(data, starts), return_inverse=True)
        found = np.searchsorted(self.hashes, keys)
        known = found < len(self.hashes)
        known[known] = self.hashes[found[known]] == keys[known]
        first, size = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        first[known], size[known] = self.first[found[known]], self.size[found[known]]
        new = np.flatnonzero(~known)
        one = np.zeros(len(keys), np.int64)
        one[at] = np.arange(len(at))  # some place of each key
        ends = np.append(starts[1:], len(data))
        segments = [joined[starts[k] : ends[k]] for k in one[new].tolist()]
        made = self.tokenizer.encode_batch_fast(
            [segment.decode() for segment in segments], add_special_tokens=False
        )
        lists = [np.array(x.ids, "<i4") for x in made]
        size[new] = [len(x) for x in lists]
        first[new] = len(self.ids) + np.cumsum(size[new]) - size[new]
        ids = np.concatenate([self.ids, *lists])
        counts = size[at]
        upto = np.cumsum(counts)
        out = ids[np.repeat(first[at] - upto + counts, counts) + np.arange(upto[-1])]
        bounds = np.concatenate([[0], upto])[np.searchsorted(starts, begins)]
        short = new[[len(segment) <= _LONGEST_KEPT for segment in segments]] if len(new) else new
        self._remember(keys, first, size, ids, short, known)
        return out, np.diff(bounds)

    def _remember(self, keys, first, size, ids, short, known) -> None:
        """Add the new short segments; when there are too many, forget those that this
        slice did not use."""
        if len(self.hashes) + len(short) <= SEGMENTS_KEPT and len(ids) <= _IDS_KEPT:
            hashes = np.concatenate([self.hashes, keys[short]])
            first = np.concatenate([self.first, first[short]])
            size = np.concatenate([self.size, size[short]])
            order = np.argsort(hashes, kind="stable")
            # Ids of long segments are left where they are until segments are forgotten.
            self._keep(hashes[order], first[order], size[order], ids)
            return
        # Only short ones were remembered, so what is known is short.
        kept = np.sort(np.concatenate([np.flatnonzero(known), short]))
        lengths = size[kept]
        upto = np.cumsum(lengths)
        at = np.repeat(first[kept] - upto + lengths, lengths) + np.arange(upto[-1] if len(upto) else 0)
        self._keep(keys[kept], upto - lengths, lengths, ids[at])

    def encode(self, text: str) -> bytes:
        """Ids of a text, as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0].astype("<u4").tobytes()


def segment_encoder(tokenizer_file: str) -> SegmentEncoder:
    """One encoder a worker and file."""
    return kept_in_worker(("segments", tokenizer_file), lambda: SegmentEncoder(tokenizer_file))


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer_file: str,
    doc_id: str = "doc_id",
    text: str = "text",
    end_id: int = 0,
    encoding: str = "dictionary",
    part_chars: int = PART_CHARS,
    row_group_bytes: int = ROW_GROUP_BYTES,
    page_bytes: int = PAGE_BYTES,
    rows_per_page: int = ROWS_PER_PAGE,
) -> None:
    """Write ``path``: (doc_id, part, row_in_part, part_start, n_tokens, ids), parts in
    ascending document order, rows of equal id by their text.

    Null and empty texts have the end id alone; null ids come first. An empty table
    gives an empty table. A text is never cut; columns other than the two are left
    out. ``encoding``: "dictionary" or "delta".
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding {encoding}")
    plain = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    parts = blocks_of(plain, F.length("text") + 1, part_chars)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    placed = (
        plain.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id())
    )
    id_type = pa.from_numpy_dtype(np.int64)
    schema = pa.schema(
        [
            ("doc_id", id_type),
            ("part", pa.int32()),
            ("row_in_part", pa.int64()),
            ("part_start", pa.int64()),
            ("n_tokens", pa.int64()),
            ("ids", pa.list_(pa.int32())),
        ]
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = segment_encoder(tokenizer_file)
        row, start = 0, 0
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for at, last in text_slices(texts, _SLICE_CHARS):
                found, sizes = encoder.encode_all(texts[at:last])
                sizes = sizes + 1
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                values = np.full(offsets[-1], end_id, "<i4")
                inside = np.ones(len(values), bool)
                inside[offsets[1:] - 1] = False
                values[inside] = found
                rows = last - at
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, rows).cast(id_type),
                        batch.column("part").slice(at, rows),
                        pa.array(np.arange(row, row + rows)),
                        pa.array(start + offsets[:-1]),
                        pa.array(sizes),
                        pa.ListArray.from_arrays(
                            pa.array(offsets.astype(np.int32)), pa.array(values)
                        ),
                    ],
                    schema=schema,
                )
                row, start = row + rows, start + int(offsets[-1])

    rows = placed.mapInArrow(
        encode,
        "doc_id long, part int, row_in_part long, part_start long, n_tokens long, ids array<int>",
    )
    options = {
        "compression": "zstd",
        "parquet.block.size": str(row_group_bytes),
        "parquet.page.size": str(page_bytes),
        "parquet.page.row.count.limit": str(rows_per_page),
        "parquet.writer.version": "v2",
        "parquet.enable.dictionary": "true" if encoding == "dictionary" else "false",
    }
    rows.write.options(**options).parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, part, row_in_part, start, n_tokens): no ids are read. ``start``: ids of
    all documents before this one."""
    rows = spark.read.parquet(path).select(
        "doc_id", "part", "row_in_part", "part_start", "n_tokens"
    )
    return _with_starts(rows)


def _with_starts(rows: DataFrame) -> DataFrame:
    """Parts are summed up in two levels: within groups of some thousand parts by windows,
    and the groups' totals, a number for 64 GB of text, on the driver."""
    spark = rows.sparkSession
    group = F.call_function("div", F.col("part"), F.lit(PARTS_IN_GROUP))
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total")).withColumn("group", group)
    summed = totals.groupBy("group").agg(F.sum("total").alias("total"), F.count(F.lit(1)).alias("n"))
    before, offsets, parts = 0, [], 0
    for row in sorted(summed.collect(), key=lambda row: row["group"]):
        offsets.append((row["group"], before))
        before, parts = before + row["total"], parts + row["n"]
    earlier = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begun = totals.join(F.broadcast(spark.createDataFrame(offsets, "group long, _group_start long")), "group")
    begun = begun.select(
        "part",
        (F.coalesce(F.sum("total").over(earlier), F.lit(0)) + F.col("_group_start")).alias("offset"),
    )
    if parts <= PARTS_SENT:
        begun = F.broadcast(begun)
    joined = rows.join(begun, "part")
    return joined.withColumn("start", F.col("offset") + F.col("part_start")).drop(
        "offset", "part_start"
    )


def read_tokens(
    spark: SparkSession, path: str, first: int | None = None, last: int | None = None
) -> DataFrame:
    """(doc_id, part, row_in_part, n_tokens, ids) of all documents, or of those with ids
    from ``first`` to ``last``: the filter reaches the row groups and pages."""
    rows = spark.read.parquet(path).drop("part_start")
    if first is not None:
        rows = rows.filter(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.filter(F.col("doc_id") <= last)
    return rows


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """All columns, ids and starts, of all documents."""
    return _with_starts(spark.read.parquet(path))


def ids_crc32(ids: Column) -> Column:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    @F.pandas_udf("long")
    def crc(lists: pd.Series) -> pd.Series:
        return pd.Series([zlib.crc32(np.asarray(x, "<u4").tobytes()) for x in lists], dtype="int64")

    return crc(ids)


def new_path(folder: str) -> str:
    return f"{folder}/paperloom-tokens-{uuid.uuid4().hex}"
