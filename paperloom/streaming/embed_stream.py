"""Incremental embedding of stored chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from paperloom import fixed_values as fixed
from paperloom import schemas
from paperloom.operators.documents import pending_chunks
from paperloom.operators.embedding import Embedder, HashedEmbedder, embed
from paperloom.sources import tables

EMBEDDING_TABLE = "document_chunk_embedding"
_SOURCE = "source_batch"
EMBEDDED = T.StructType([*schemas.CHUNK_EMBEDDING.fields, T.StructField(_SOURCE, T.LongType())])


def start_embedding(
    spark: SparkSession,
    store: str,
    checkpoint: str,
    embedder: Embedder | None = None,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Embed chunks written since the last run, then stop.

    A replayed ingest batch rewrites its files, which this stream then reads
    again; chunks that have an embedding already are left out.
    """
    embedder = embedder or HashedEmbedder()
    # A replay may replace files that were listed but not read: its new files count.
    reader = spark.readStream.schema(schemas.with_batch(schemas.CHUNK)).option(
        "ignoreMissingFiles", "true"
    )
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    chunks = reader.parquet(tables.table_path(store, fixed.CHUNK_TABLE))

    def embed_new(batch: DataFrame, batch_id: int) -> None:
        embed_batch(batch, store, batch_id, embedder)

    return (
        chunks.writeStream.foreachBatch(embed_new)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def embed_batch(chunks: DataFrame, store: str, batch_id: int, embedder: Embedder) -> None:
    """Embed the chunks of a batch that earlier batches have not embedded.

    The check reads only the partitions of the ingest batches at hand, whose span
    is two numbers, so its cost does not grow with the whole table.
    """
    spark = chunks.sparkSession
    span = chunks.agg(F.min("batch_id").alias("low"), F.max("batch_id").alias("high")).first()
    if span is None or span["low"] is None:
        return
    done = (
        tables.read_table(spark, store, EMBEDDING_TABLE, EMBEDDED)
        .filter(F.col(_SOURCE).between(span["low"], span["high"]))
        .filter(F.col("batch_id") != batch_id)
    )
    fresh = pending_chunks(chunks, done)
    vectors = embed(
        fresh.select("document_id", "chunk_index", "chunk_text", F.col("batch_id").alias(_SOURCE)),
        "chunk_text",
        embedder,
    )
    rows = vectors.select("document_id", "chunk_index", "embedding", _SOURCE)
    tables.write_batch(rows, store, EMBEDDING_TABLE, batch_id, within=[_SOURCE])
