"""Look-ups and checks over the document, chunk and embedding tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.plans.spread import salted_join


def latest_ids(
    documents: DataFrame,
    key: str = "document_uuid",
    created: str = "created_at",
    id_column: str = "id",
) -> DataFrame:
    """Newest row per key: its time and id. Equal times go to the greater id.

    An aggregate, so every task sends one row per key, however often it occurs.
    """
    return (
        documents.groupBy(key)
        .agg(F.max(F.struct(created, id_column)).alias("_newest"))
        .select(key, *[F.col("_newest")[name].alias(name) for name in (created, id_column)])
    )


def latest_one(
    documents: DataFrame,
    value,
    key: str = "document_uuid",
    created: str = "created_at",
    id_column: str = "id",
) -> DataFrame:
    """Newest row of one key."""
    return (
        documents.filter(F.col(key) == F.lit(value))
        .orderBy(F.col(created).desc(), F.col(id_column).desc())
        .limit(1)
    )


def attach_document_ids(
    chunks: DataFrame, documents: DataFrame, key: str = "document_uuid"
) -> DataFrame:
    """Chunks with the id of the newest document of their key. Those without one are
    given out by :func:`rejected_chunks`."""
    return matched_chunks(chunks, documents, key).filter(F.col("document_id").isNotNull())


def rejected_chunks(
    chunks: DataFrame, documents: DataFrame, key: str = "document_uuid"
) -> DataFrame:
    """Chunks without a document of their key, which have a null ``document_id``."""
    return matched_chunks(chunks, documents, key).filter(F.col("document_id").isNull())


def matched_chunks(
    chunks: DataFrame, documents: DataFrame, key: str = "document_uuid"
) -> DataFrame:
    """All chunks, with the id of the newest document of their key or null: one pass to
    be split into good and rejected ones.

    A document may have most of the chunks, so they are dealt over partitions.
    """
    newest = latest_ids(documents, key).select(key, F.col("id").alias("document_id"))
    return salted_join(chunks, newest, [key], F.col("chunk_index"), "left")


def orphan_chunks(
    chunks: DataFrame, documents: DataFrame, document_key: str = "id"
) -> DataFrame:
    """Chunks whose document does not exist.

    Both sides are shuffled as they are, so adaptive execution can split a
    document that has most of the chunks.
    """
    known = documents.select(F.col(document_key).alias("document_id"))
    return chunks.join(known, "document_id", "left_anti")


def unchunked_documents(
    documents: DataFrame, chunks: DataFrame, document_key: str = "id"
) -> DataFrame:
    """Documents without a chunk. One row per chunked document is shuffled."""
    chunked = chunks.select(F.col("document_id").alias(document_key)).distinct()
    return documents.join(chunked, document_key, "left_anti")


def pending_chunks(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Chunks that have no embedding yet."""
    done = embeddings.select("document_id", "chunk_index")
    return chunks.join(done, ["document_id", "chunk_index"], "left_anti")


def duplicate_keys(rows: DataFrame, *keys: str | Column) -> DataFrame:
    """Keys that occur more than once, which a primary key must not."""
    return (
        rows.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("occurrences"))
        .filter(F.col("occurrences") > 1)
    )
