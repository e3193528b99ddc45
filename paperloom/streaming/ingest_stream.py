"""Incremental ingest of the landing folder."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from paperloom.operators import ingest
from paperloom.plans.ingest_flow import ingest_batch, is_taken_in, request_names
from paperloom.sources.landing import landing_stream


def _now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")


def start_ingest(
    spark: SparkSession,
    landing_folder: str,
    store: str,
    checkpoint: str,
    decoder: ingest.Decoder = ingest.utf8_pages,
    splitter: Callable[[str], list[str]] | None = None,
    files_per_batch: int | None = None,
    clock: Callable[[], str] = _now,
) -> StreamingQuery:
    """Take in all files not handled yet, then stop.

    The checkpoint remembers handled files; a batch that is replayed after a
    failure has the same id and files, and replaces what it wrote before, unless it was
    finished: its files may be archived by then (``archive_stream.start_archiving``).
    """
    files = landing_stream(spark, landing_folder, files_per_batch)

    def take_in(batch: DataFrame, batch_id: int) -> None:
        if not is_taken_in(spark, store, batch, batch_id):
            ingest_batch(batch, store, batch_id, clock(), decoder, splitter, named=False)
        request_names(spark, store, batch_id)

    return (
        files.writeStream.foreachBatch(take_in)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
