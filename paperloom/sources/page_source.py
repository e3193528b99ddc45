"""A data source that gives the pages of text files, read by ranges of bytes.

A file that no cell can hold is read by many tasks. A page belongs to the range that it
begins in; its reader goes on beyond the range until the page ends. Files are read
through pyarrow's file systems.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    InputPartition,
)

from paperloom import fixed_values as fixed
from paperloom.plans import spread
from paperloom.sources.archive import open_path

RANGE_BYTES = 64 * 1024 * 1024
_PIECE = 1 << 20
_BATCH_BYTES = 4 << 20

PAGES = (
    "path string, modificationTime timestamp, begins long, page_text string, error_message string"
)

PageDecoder = Callable[[bytes], str]


def utf8_page(content: bytes) -> str:
    return content.decode("utf-8")


class _Range(InputPartition):
    def __init__(self, path: str, modified: int, first: int, last: int, size: int):
        self.path, self.modified = path, modified
        self.first, self.last, self.size = first, last, size


def listed(folder: str, suffix: str) -> list[tuple[int, str, int]]:
    """(modified, path, size) of the files below a folder whose names end in ``suffix``, in
    any case, oldest first; nothing where there is no folder yet. Empty files are passed
    over, as Spark's own sources do."""
    system, root = open_path(folder)
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True))
    scheme = folder.split(":", 1)[0] if re.match(r"[a-z0-9]+:", folder) else "file"
    start = folder.split("//", 1)[1].split("/", 1)[0] if "://" in folder else ""
    out = []
    for info in found:
        named = info.path.lower().endswith(suffix.lower())
        if info.type != fs.FileType.File or not info.size or not named:
            continue
        plain = info.path if info.path.startswith("/") else f"/{info.path.split('/', 1)[-1]}"
        path = f"file:{plain}" if scheme == "file" else f"{scheme}://{start}{plain}"
        out.append((info.mtime_ns // 1000, path, info.size))
    return sorted(out)


def ranges(files: list[tuple[int, str, int]], size: int) -> list[_Range]:
    out = []
    for modified, path, length in files:
        for first in range(0, max(length, 1), size):
            out.append(_Range(path, modified, first, min(first + size, length), length))
    return out


def pages_in(part: _Range, boundary: bytes) -> Iterator[tuple[int, bytes]]:
    """(place, content) of the pages that begin in a range. A page begins with the file and
    behind each boundary, also behind one that ends the file."""
    system, path = open_path(part.path)
    with system.open_input_file(path) as source:
        at = max(part.first - 1, 0)
        source.seek(at)
        begins: int | None = 0 if part.first == 0 else None
        held: list[bytes] = []
        while begins is None or begins < part.last or part.last == part.size:
            piece = source.read(_PIECE)
            if not piece:
                if begins is not None:
                    yield begins, b"".join(held)
                return
            *ended, rest = piece.split(boundary)
            for content in ended:
                if begins is not None:
                    yield begins, b"".join([*held, content])
                held = []
                at += len(content) + 1
                begins = at
                if begins >= part.last and part.last < part.size:
                    return
            if begins is not None:
                held.append(rest)
            elif at + len(rest) >= part.last and part.last < part.size:
                return  # no page begins here
            at += len(rest)


class _Pages:
    """What the batch and the stream reader share."""

    def __init__(self, options: dict, decode: PageDecoder):
        self.folder = options["path"]
        self.suffix = options.get("suffix", fixed.FILE_SUFFIX)
        self.size = int(options.get("rangebytes", RANGE_BYTES))
        self.boundary = options.get("boundary", "\f").encode()
        self.decode = decode
        if len(self.boundary) != 1 or self.size < 1:
            raise ValueError("a boundary is one byte, and a range has one at least")

    def read(self, partition: _Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # without files there is one task without a range
            return
        schema = pa.schema(
            [
                ("path", pa.string()),
                ("modificationTime", pa.timestamp("us", tz="UTC")),
                ("begins", pa.int64()),
                ("page_text", pa.string()),
                ("error_message", pa.string()),
            ]
        )
        modified = datetime.fromtimestamp(partition.modified / 1e6, timezone.utc)
        rows, held = [], 0
        for begins, content in pages_in(partition, self.boundary):
            text, error = None, None
            try:
                text = self.decode(content)
            except Exception as failure:
                error = fixed.EXTRACTION_FAILED + (str(failure) or type(failure).__name__)
            rows.append((partition.path, modified, begins, text, error))
            held += len(content)
            if held > _BATCH_BYTES or len(rows) >= 10_000:
                yield _batch(rows, schema)
                rows, held = [], 0
        if rows:
            yield _batch(rows, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema
    )


class _Reader(_Pages, DataSourceReader):
    def partitions(self) -> list[_Range]:
        return ranges(listed(self.folder, self.suffix), self.size)


class _StreamReader(_Pages, DataSourceStreamReader):
    """Files in the order of their time and path; one that appears with an earlier time
    than a file seen before it is not taken in."""

    def initialOffset(self) -> dict:
        return {"modified": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = listed(self.folder, self.suffix)
        if not files:
            return self.initialOffset()
        return {"modified": files[-1][0], "path": files[-1][1]}

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        after, upto = (start["modified"], start["path"]), (end["modified"], end["path"])
        files = [f for f in listed(self.folder, self.suffix) if after < f[:2] <= upto]
        return ranges(files, self.size)

    def commit(self, end: dict) -> None:
        pass


def page_format(name: str = "text_pages", decode: PageDecoder = utf8_page) -> type[DataSource]:
    """A data source of this name whose pages ``decode`` turns into text. Options: the
    folder (``path``), ``suffix``, ``rangeBytes`` and ``boundary``."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return PAGES

        def reader(self, schema) -> DataSourceReader:
            return _Reader(self.options, decode)

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _StreamReader(self.options, decode)

    return Source


def read_pages(
    spark: SparkSession, folder: str, decode: PageDecoder = utf8_page, **options: str | int
) -> DataFrame:
    """One row a page (``path, modificationTime, begins, page_text, error_message``)."""
    spark.dataSource.register(page_format(decode=decode))
    return spark.read.format("text_pages").options(**options).load(folder)


def stream_pages(
    spark: SparkSession, folder: str, decode: PageDecoder = utf8_page, **options: str | int
) -> DataFrame:
    """The same as a stream of files that appear."""
    spark.dataSource.register(page_format(decode=decode))
    return spark.readStream.format("text_pages").options(**options).load(folder)


def numbered_pages(pages: DataFrame) -> DataFrame:
    """``path, page_no, page_text`` of files whose pages can all be read, numbered from 0.
    A file of very many pages is spread over tasks."""
    failed = pages.filter(F.col("error_message").isNotNull()).select("path").distinct()
    good = pages.select("path", "begins", "page_text").join(failed, "path", "left_anti")
    counted = spread.running_sum(
        good,
        ["path"],
        spread.by_number(F.col("begins"), RANGE_BYTES),
        ["begins"],
        F.lit(1),
        "_upto",
    )
    return counted.select("path", (F.col("_upto") - 1).alias("page_no"), "page_text")
