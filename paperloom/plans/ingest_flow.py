"""One ingest batch: decode, store documents, chunk, store chunks and errors."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from paperloom import fixed_values as fixed
from paperloom import schemas
from paperloom.functions.text import as_timestamp
from paperloom.operators import chunking, ingest, name_registry, naming
from paperloom.sources import tables

DISPOSITION_TABLE = "file_disposition"
REQUEST_TABLE = "name_request"
TAKE_TABLE = "name_take"
GRANT_TABLE = "name_grant"
MOVE_TABLE = "file_move"
BATCH_TABLE = "finished_batch"

COUNTED = ("files", "chunks", "errors")
FINISHED = (
    "files long, documents long, chunks long, errors long, seconds double, created_at timestamp"
)
DISPOSITION = (
    "src_path string, file_name string, outcome string, target_folder string, "
    "archived_path string"
)


def ingest_batch(
    files: DataFrame,
    store: str,
    batch_id: int,
    created_at: str | datetime,
    decoder: ingest.Decoder = ingest.utf8_pages,
    splitter: Callable[[str], list[str]] | None = None,
    processed_folder: str = "processed",
    error_folder: str = "errors",
    named: bool = True,
) -> None:
    """Take a batch of landing files into the tables below ``store``.

    Files are decoded once and their rows, documents and errors alike, are written
    in one pass; everything else is read from there. So a lost executor repeats its
    own part of one step, and a file has one outcome. A batch is listed as finished
    last, after all its tables are written; readers join on that list. Running the
    batch again replaces its rows. The finished list also holds the batch's report:
    files, documents, chunks, errors and seconds, counted while tables are written.

    With ``named`` the files' archive names are found here, which reads those of all
    earlier batches. Without, :func:`request_names` asks for them, and
    ``streaming.archive_stream`` gives them from its state and moves the files.
    """
    spark = files.sparkSession
    started = time.monotonic()
    seen = {name: Observation(f"{name}-{batch_id}-{uuid.uuid4()}") for name in COUNTED}

    def counted(name: str, rows: DataFrame) -> DataFrame:
        return rows.observe(seen[name], F.count(F.lit(1)).alias("rows"))

    decoded = ingest.file_rows(ingest.decode_files(files, decoder), created_at)
    rows = decoded.observe(
        seen["files"],
        F.count(F.lit(1)).alias("rows"),
        F.count("error_message").alias("unread"),
    )
    tables.write_batch(rows, store, schemas.FILE_TABLE, batch_id, within=["outcome"])
    stored = tables.read_batch(spark, store, schemas.FILE_TABLE, schemas.FILE, batch_id)
    documents = stored.filter(F.col("outcome") == ingest.PROCESSED)

    keyed = documents.select(F.col("id").alias("document_id"), "file_path", "text")
    chunked = chunking.recursive_chunks(keyed, ["document_id", "file_path"], splitter=splitter)
    failures = Observation(f"failures-{batch_id}-{uuid.uuid4()}")
    good = chunked.observe(failures, F.count("error").alias("rows")).filter(F.col("error").isNull())
    tables.write_batch(
        counted(
            "chunks", chunking.chunk_rows(good, created_at, "document_id", F.col("file_path"))
        ),
        store,
        fixed.CHUNK_TABLE,
        batch_id,
    )

    errors = ingest.failed_rows(stored, created_at)
    if failures.get["rows"]:
        # Rare, so the texts are only then gone through again for the messages.
        errors = errors.unionByName(ingest.chunk_error_rows(chunked, created_at))
    tables.write_batch(counted("errors", errors), store, fixed.ERROR_TABLE, batch_id)
    if named:
        disposed = disposed_files(spark, store, stored, batch_id, processed_folder, error_folder)
        tables.write_batch(disposed, store, DISPOSITION_TABLE, batch_id)
    report = {name: seen[name].get["rows"] for name in COUNTED}
    unread = seen["files"].get["unread"]
    finished = spark.createDataFrame(
        [
            (
                report["files"],
                report["files"] - unread,
                report["chunks"],
                report["errors"],
                round(time.monotonic() - started, 3),
            )
        ],
        "files long, documents long, chunks long, errors long, seconds double",
    ).withColumn("created_at", as_timestamp(created_at))
    tables.write_batch(finished, store, BATCH_TABLE, batch_id)


def disposed_files(
    spark: SparkSession,
    store: str,
    files: DataFrame,
    batch_id: int,
    processed_folder: str,
    error_folder: str,
) -> DataFrame:
    """Target of each file of the batch: names are free in its folder's earlier batches."""
    schema = spark.createDataFrame([], DISPOSITION).schema
    earlier = tables.read_table(spark, store, DISPOSITION_TABLE, schema).filter(
        F.col("batch_id") < batch_id
    )
    # A name is taken within its folder, so folder and name are counted together.
    whole = F.concat("target_folder", F.lit("/"), "file_name")
    disposed = ingest.dispositions(files, processed_folder, error_folder)
    named = naming.archive_names(
        disposed.select("src_path", whole.alias("file_name")),
        earlier.select(F.col("archived_path").alias("file_name")),
    )
    return disposed.join(
        named.select("src_path", F.col("archive_name").alias("archived_path")), "src_path"
    )


def request_names(
    spark: SparkSession,
    store: str,
    batch_id: int,
    processed_folder: str = "processed",
    error_folder: str = "errors",
) -> None:
    """Ask for archive names of a finished batch's files. Files are moved once they have
    names, so this comes after the batch is finished and never needs them again."""
    stored = tables.read_batch(spark, store, schemas.FILE_TABLE, schemas.FILE, batch_id)
    asked = name_registry.requests(ingest.dispositions(stored, processed_folder, error_folder))
    tables.write_batch(asked, store, REQUEST_TABLE, batch_id)
    schema = spark.createDataFrame([], name_registry.REQUESTED).schema
    asked = tables.read_batch(spark, store, REQUEST_TABLE, schema, batch_id)
    tables.write_batch(name_registry.takes(asked), store, TAKE_TABLE, batch_id)


def is_taken_in(spark: SparkSession, store: str, files: DataFrame, batch_id: int) -> bool:
    """Whether a batch is finished and held all of these files (``path``)."""
    schema = spark.createDataFrame([], FINISHED).schema
    if tables.read_batch(spark, store, BATCH_TABLE, schema, batch_id).isEmpty():
        return False
    stored = tables.read_batch(spark, store, schemas.FILE_TABLE, schemas.FILE, batch_id)
    known = stored.select(F.col("file_path").alias("path"))
    return files.select("path").join(known, "path", "left_anti").isEmpty()


def finished_rows(spark: SparkSession, store: str, rows: DataFrame) -> DataFrame:
    """Stored rows whose batch is finished, so that no half-written batch is seen."""
    batches = tables.read_table(
        spark, store, BATCH_TABLE, spark.createDataFrame([], FINISHED).schema
    ).select("batch_id")
    return rows.join(batches, "batch_id", "left_semi")
