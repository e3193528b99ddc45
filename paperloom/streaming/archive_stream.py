"""Names and places for handled files, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paperloom import schemas
from paperloom.operators import name_registry
from paperloom.plans import ingest_flow
from paperloom.sources import tables
from paperloom.sources.archive import Mover, move_file, moved_files

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def start_archiving(
    spark: SparkSession,
    store: str,
    checkpoint: str,
    archive_folder: str,
    mover: Mover = move_file,
) -> StreamingQuery:
    """Name and move the files of all ingest batches not archived yet, then stop.

    Counters in use are state of the stream, by name, so a batch costs what its own files
    cost. Where the files go is stored before any is moved (``file_disposition``), what
    became of them afterwards (``file_move``); a batch that was cut off in between is
    named alike when it is replayed, and moves go on where they stopped.

    ``archive_folder`` is not to lie in the landing folder. The session's state stores are
    kept in RocksDB, which this sets.
    """
    spark.conf.set(_PROVIDER, name_registry.ROCKS_DB)
    asked = tables.table_path(store, ingest_flow.TAKE_TABLE)
    schema = schemas.with_batch(spark.createDataFrame([], name_registry.TAKEN).schema)
    # Partitions of batches are read as columns; the folder has to be there.
    tables.make_folder(spark, asked)
    taken = spark.readStream.schema(schema).parquet(asked)

    def archive(grants: DataFrame, number: int) -> None:
        tables.write_batch(grants, store, ingest_flow.GRANT_TABLE, number)
        archive_batch(spark, store, number, archive_folder, mover)

    return (
        name_registry.grant(taken)
        .writeStream.foreachBatch(archive)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def archive_batch(
    spark: SparkSession, store: str, number: int, archive_folder: str, mover: Mover = move_file
) -> None:
    """Store where the files of one turn's grants go, and move them there."""
    schema = spark.createDataFrame([], name_registry.GRANTED).schema
    path = tables.table_path(store, ingest_flow.GRANT_TABLE) + f"/batch_id={number}"
    grants = spark.read.schema(schema).parquet(path)
    # A turn takes in what ingest batches were finished since the last one: few numbers.
    for row in grants.select("batch_id").distinct().orderBy("batch_id").collect():
        batch = row["batch_id"]
        requested = tables.read_batch(
            spark, store, ingest_flow.REQUEST_TABLE,
            spark.createDataFrame([], name_registry.REQUESTED).schema, batch,
        )
        named = name_registry.granted_names(requested, grants.filter(F.col("batch_id") == batch))
        tables.write_batch(named, store, ingest_flow.DISPOSITION_TABLE, batch)
        disposed = tables.read_batch(
            spark, store, ingest_flow.DISPOSITION_TABLE,
            spark.createDataFrame([], ingest_flow.DISPOSITION).schema, batch,
        )
        tables.write_batch(moved_files(disposed, archive_folder, mover), store, ingest_flow.MOVE_TABLE, batch)
