"""From landing files to document and error rows."""

from __future__ import annotations

import traceback
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom import fixed_values as fixed
from paperloom import schemas
from paperloom.functions.text import (
    as_timestamp,
    document_uuid,
    expiry,
    file_name,
    ordered_text,
    word_count,
)

PROCESSED, FAILED = "processed", "error"

Decoder = Callable[[bytes], list[str]]

DECODED_SCHEMA = (
    "path string, modificationTime timestamp, pages array<string>, "
    "error_message string, stack_trace string"
)


def utf8_pages(content: bytes) -> list[str]:
    """Pages of a UTF-8 text file; a form feed ends a page."""
    return content.decode("utf-8").split("\f")


def decode_files(files: DataFrame, decoder: Decoder = utf8_pages) -> DataFrame:
    """Read each file's bytes into page texts, once, where the file is scanned.

    ``decoder`` turns bytes into a list of page texts. A file it cannot read gives
    a row with the message and stack trace and no pages; the others go on.
    """

    def read(content: bytes) -> tuple:
        try:
            if content is None:
                raise ValueError("file has no content")
            return decoder(content), None, None
        except Exception as failure:
            message = str(failure) or type(failure).__name__
            return None, fixed.EXTRACTION_FAILED + message, traceback.format_exc()

    def read_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            decoded = [read(content) for content in batch["content"]]
            columns = ["pages", "error_message", "stack_trace"]
            results = pd.DataFrame(decoded, columns=columns, index=batch.index, dtype=object)
            yield batch[["path", "modificationTime"]].join(results)

    wanted = files.select("path", "modificationTime", "content")
    return wanted.mapInPandas(read_batches, DECODED_SCHEMA)


def page_rows(decoded: DataFrame) -> DataFrame:
    """Decoded files as one row per page, numbered from 0."""
    return decoded.select("path", F.posexplode("pages").alias("page_no", "page_text"))


def assemble_pages(pages: DataFrame, key: str = "path") -> DataFrame:
    """Text and page count per file from a table of page rows in any order.

    A group ends up in one cell, the file's text; no plan can spread that. The
    ingest jobs keep a file's pages in one row and need no shuffle at all.
    """
    page = F.struct(F.col("page_no").alias("position"), F.col("page_text").alias("text"))
    items = F.collect_list(page)
    return pages.groupBy(key).agg(
        F.count(F.lit(1)).cast("int").alias("page_count"),
        ordered_text(items, "").alias("text"),
    )


def document_id(path: Column, modified: Column) -> Column:
    """Key of a document. It follows from the file and its version, so a replayed
    batch gives the same documents the same ids."""
    return F.xxhash64(path, modified)


def file_rows(decoded: DataFrame, created_at) -> DataFrame:
    """One row per decoded file: the columns of its document, or its error, and
    ``outcome``, processed or error. Both kinds can be written in one pass."""
    now = as_timestamp(created_at)
    path, modified = F.col("path"), F.col("modificationTime")
    read = F.col("error_message").isNull()
    return decoded.select(
        document_id(path, modified).alias("id"),
        document_uuid(path, modified).alias("document_uuid"),
        F.when(read, F.size("pages")).cast("int").alias("page_count"),
        F.array_join("pages", "").alias("text"),
        file_name(path).alias("file_name"),
        path.alias("file_path"),
        "error_message",
        "stack_trace",
        F.when(read, PROCESSED).otherwise(FAILED).alias("outcome"),
    ).select(
        "id",
        "document_uuid",
        now.alias("upload_timestamp"),
        "page_count",
        F.when(F.col("text").isNotNull(), word_count(F.col("text"))).alias("word_count"),
        now.alias("created_at"),
        expiry(now).alias("expires_at"),
        "text",
        "file_name",
        "file_path",
        "error_message",
        "stack_trace",
        "outcome",
    )


def document_rows(decoded: DataFrame, created_at) -> DataFrame:
    """Rows of the document table for the files that could be read."""
    rows = file_rows(decoded, created_at).filter(F.col("outcome") == PROCESSED)
    return rows.select(*schemas.DOCUMENT.names)


def error_rows(decoded: DataFrame, error_timestamp) -> DataFrame:
    """Rows of the error table for the files that could not be read."""
    return failed_rows(file_rows(decoded, error_timestamp), error_timestamp)


def failed_rows(files: DataFrame, error_timestamp) -> DataFrame:
    """The same from file rows."""
    return files.filter(F.col("outcome") == FAILED).select(
        F.xxhash64("id", "error_message").alias("id"),
        as_timestamp(error_timestamp).alias("error_timestamp"),
        "file_name",
        "file_path",
        "error_message",
        F.coalesce("stack_trace", F.lit("")).alias("stack_trace"),
    )


def chunk_error_rows(chunked: DataFrame, error_timestamp) -> DataFrame:
    """Error rows for documents that could not be chunked, from the chunker's output
    (``document_id, file_path, error``)."""
    return chunked.filter(F.col("error").isNotNull()).select(
        F.xxhash64("document_id", "error").alias("id"),
        as_timestamp(error_timestamp).alias("error_timestamp"),
        file_name(F.col("file_path")).alias("file_name"),
        "file_path",
        F.concat(
            F.lit(fixed.CHUNKING_FAILED),
            F.col("document_id").cast("string"),
            F.lit(": "),
            F.substring_index("error", "\n", 1),
        ).alias("error_message"),
        F.col("error").alias("stack_trace"),
    )


def dispositions(files: DataFrame, processed_folder: str, error_folder: str) -> DataFrame:
    """Where each handled file (see ``file_rows``) goes: path, name, outcome, folder.

    The source path stays in the tables as lineage; this adds where the bytes are
    archived. Names within a folder come from ``naming.archive_names``.
    """
    folder = F.when(F.col("outcome") == FAILED, error_folder).otherwise(processed_folder)
    return files.select(
        F.col("file_path").alias("src_path"), "file_name", "outcome", folder.alias("target_folder")
    )
